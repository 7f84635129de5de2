"""Invented statement files; only the header names are those of the known layouts."""

WALLET_HEADER = "data,hora,tipo,origem / destino,valor,forma de pagamento"
#: 8 rows: one repeated as it is, Unicode and plain minus signs, words and methods without a direction.
WALLET = "\n".join(
    [
        WALLET_HEADER,
        '2025-11-21,21:07:33,Compra,Oficina Girassol,"−R$ 311,04",Cartao PicPay',
        '2025-11-21,21:09:02,Envio,Tito Sabino,"−R$ 5,55",Pix',
        '2025-11-24,00:31:48,Pix recebido,Vila Norte Aluguel,"+R$ 1.940,60",Saldo PicPay',
        '2025-12-02,13:13:13,Compra,Padaria Tres Rios,"−R$ 8,90",Saldo PicPay',
        '2025-12-02,13:13:13,Compra,Padaria Tres Rios,"−R$ 8,90",Saldo PicPay',
        '2025-12-13,16:44:20,Estorno,Oficina Girassol,"+R$ 102,01",Cartao PicPay',
        '2025-12-19,09:58:07,Compra,Loteria Azul,"-R$ 0,75",Boleto',
        '2025-12-30,23:59:59,Compra,Barbearia Quatro,"−R$ 67,00",Pix',
        "",
    ]
)
#: 7 rows: an opening balance, a text with the delimiter in it, an unreliable id.
BANK = "\n".join(
    [
        "Conta corrente 77-1 - periodo de janeiro;;;;;",
        "Data;Historico;Docto.;Credito;Debito;Saldo",
        "05/01/2027;TED DE TERCEIRO;550019;3.210,45;;4.020,95",
        "04/01/2027;SALDO ANTERIOR;0;;;810,50",
        "07/01/2027;TARIFA PACOTE;0;;39,90;3.981,05",
        "11/01/2027;BOLETO;ESCOLA MUSICAL;9087;;612,15;3.368,90",
        "18/01/2027;DEBITO AUTOMATICO LUZ;7001234;;143,72;3.225,18",
        "25/01/2027;JUROS POUPANCA;31;2,27;;3.227,45",
        "29/01/2027;CHEQUE COMPENSADO;880055;;1.000,00;2.227,45",
        "",
    ]
)
NEW_LAYOUT = "Data Movimento;Detalhes;Montante;Natureza\n21/05/2028;Feira Livre;7,35;Pagamento\n30/05/2028;Venda Bicicleta;415,20;Entrada\n"


def write(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.write_bytes(text.encode(encoding))
    return f"file:{path}"
