"""Texts with values of every type, valid ones and ones that a check turns down, for queries over tables that hold few of them."""

#: Public test values by type; the text is what stands before the value, the value, and " end".
VALUES: dict[str, list[tuple[str, str]]] = {
    "EMAIL_ADDRESS": [("email:", "jane@example.com"), ("the recipient is", "jane@example.com"), ("Reservación:", "a.b-c+d@mail.example.org"), ("x", "..a@b.c-@d.e")],
    "PHONE_NUMBER": [("call", "415-555-2671"), ("phone", "(415) 555-2671"), ("call", "+1 (415) 555-2671"), ("contato", "+55 11 91234-5678"), ("tel", "+5511912345678."), ("celular", "11912345678"), ("office", "+442071838750"), ("at", "+49 30 901820"), ("total", "2+34567890"), ("id", "+123456789012345678"), ("é", "415 555 2671"), ("a\tb\n415\t555\t2671", "")],
    "CREDIT_CARD": [("card", "4532015112830366"), ("card", "4111 1111 1111 1111"), ("card", "4532015112830367"), ("pay", "4111-1111-1111-1111")],
    "CRYPTO": [("btc wallet", "1BoatSLRHtKNngkdXEeobR76b53LETtpyT"), ("to", "0x52908400098527886E0F7030069857D2E4169EE7")],
    "IP_ADDRESS": [("ip", "10.0.0.1"), ("host", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"), ("version", "256.1.1.1")],
    "URL": [("link", "https://example.org/a?b=c#d."), ("see", "www.example.org!!"), ("x", "ftp://a b")],
    "DATE_TIME": [("born", "01/02/1990"), ("on", "2024-01-15"), ("date", "January 15, 2024"), ("x", "Jan. 3 2025"), ("x", "13/41/2020")],
    "IBAN_CODE": [("iban", "DE89370400440532013000"), ("x", "GB82WEST12345698765432"), ("account", "DE89 3704 0044 0532 0130 00"), ("x", "DE89370400440532013001"), ("x", "XX00")],
    "US_SSN": [("ssn", "536-90-4399"), ("x", "078-05-1120"), ("social security", "457554462"), ("x", "123-45-6789"), ("x", "000-12-3456"), ("x", "666-12-3456"), ("x", "900-12-3456"), ("x", "536-00-4399"), ("x", "111111111")],
    "US_ITIN": [("itin", "970-12-3456"), ("x", "950-70-1234"), ("x", "966-12-3456"), ("x", "970-00-3456"), ("x", "970-12-0000"), ("x", "970123456")],
    "US_PASSPORT": [("passport", "123456789"), ("travel documents", "A12345678"), ("x", "A1234567")],
    "US_DRIVER_LICENSE": [("driver license", "A1234567"), ("dl", "AB12345"), ("x", "A123456789012")],
    "US_BANK_NUMBER": [("bank account", "12345678901"), ("x", "12345678"), ("x", "1234567")],
    "ABA_ROUTING": [("routing", "021000021"), ("x", "011401533"), ("x", "021000022")],
    "MEDICAL_LICENSE": [("physician", "AB123456"), ("x", "Z1234"), ("x", "Z123")],
    "UK_NHS": [("nhs", "9434765919"), ("x", "943 476 5919"), ("x", "9434765918"), ("a\n943\t476\t5919", "")],
    "UK_NINO": [("nino", "AB123456C"), ("x", "AB 12 34 56 C"), ("x", "BG123456C"), ("x", "AB123456E")],
    "AU_TFN": [("tfn", "123456782"), ("x", "123 456 782"), ("x", "123456789")],
    "AU_ABN": [("abn", "51824753556"), ("x", "51 824 753 556"), ("x", "51824753557")],
    "AU_ACN": [("acn", "004085616"), ("x", "004 085 616"), ("x", "004085617")],
    "AU_MEDICARE": [("medicare", "2123456701"), ("x", "2123 45670 1"), ("x", "7123456701"), ("x", "2123456711")],
    "IN_AADHAAR": [("aadhaar", "234123412346"), ("x", "2341 2341 2346"), ("x", "234123412347")],
    "IN_PAN": [("pan", "ABCDE1234F"), ("x", "ABCD1234F")],
    "IN_PASSPORT": [("passport", "A1234567"), ("x", "A123456")],
    "IN_VEHICLE_REGISTRATION": [("car", "KA 01 AB 1234"), ("x", "KA01A1234"), ("KA\t01\tAB\t1234", "")],
    "IN_VOTER": [("epic", "ABC1234567"), ("x", "AB1234567")],
    "IN_GSTIN": [("gst", "22ABCDE1234F1Z5"), ("x", "22ABCDE1234F1X5")],
    "IT_FISCAL_CODE": [("codice fiscale", "RSSMRA85T10A562S"), ("x", "RSSMRA85T10A562C"), ("x", "RSSMRA85T10A562X")],
    "IT_VAT_CODE": [("partita iva", "00743110157"), ("x", "00743110158")],
    "IT_IDENTITY_CARD": [("carta identita", "AB12345CD"), ("x", "AB12345"), ("x", "AB1234")],
    "IT_DRIVER_LICENSE": [("patente", "AB1234567C"), ("x", "AB123456C")],
    "IT_PASSPORT": [("passaporto", "AB1234567"), ("x", "ABC1234567")],
    "ES_NIF": [("nif", "12345678Z"), ("x", "12345678A")],
    "ES_NIE": [("nie", "X1234567L"), ("x", "X1234567A"), ("x", "Y0000000Z")],
    "SG_FIN": [("fin", "F1234567N"), ("x", "G1234567X"), ("x", "M1234567K"), ("x", "F1234567A")],
    "SG_UEN": [("company uen", "12345678A"), ("x", "123456789A"), ("x", "T12AB1234C")],
    "BR_CPF": [("cpf", "11144477735"), ("x", "111.444.777-35"), ("x", "11144477736"), ("x", "11111111111"), ("x", "529.982.247-25")],
    "BR_CNPJ": [("cnpj", "11222333000181"), ("x", "11.222.333/0001-81"), ("x", "11222333000182"), ("x", "00000000000000")],
    "BR_RG": [("identidade", "12.345.678-9"), ("x", "1.234.567-X"), ("x", "1.234.56-7")],
    "BR_CNH": [("cnh", "98765432109"), ("x", "98765432108"), ("x", "11111111111")],
    "BR_PIS": [("pis", "12345678900"), ("x", "123.45678.90-0"), ("x", "12345678901"), ("x", "00000000000")],
    "BR_CNS": [("cns", "297220185600003"), ("x", "165969980860009"), ("sus", "823111431391203"), ("x", "297 2201 8560 0003"), ("x", "297220185600004"), ("x", "397220185600003"), ("x", "297220185600100")],
    "BR_TITULO_ELEITORAL": [("título eleitor", "483917830248"), ("x", "0709 2329 1295"), ("x", "483917830249"), ("x", "483917839948")],
    "BR_RENAVAM": [("renavam", "20193580815"), ("x", "31974898449"), ("x", "20193580816"), ("x", "11111111111")],
    "BR_CEP": [("cep", "01310-100"), ("código postal", "01310100"), ("CEP:", "01310100"), ("x", "01310100")],
    "BR_PLACA": [("placa", "abc1d23"), ("veículo", "ABC-1234"), ("x", "ABCD1234")],
    "BR_PIX_KEY": [("chave pix", "123e4567-e89b-42d3-a456-426614174000"), ("x", "123e4567-e89b-42d3-a456-426614174000"), ("pix", "123e4567-e89b-12d3-a456-426614174000")],
    "PL_PESEL": [("pesel", "44051401359"), ("x", "44051401358")],
    "KR_RRN": [("rrn", "900101-1234568"), ("x", "900101-1234567")],
    "FI_PERSONAL_IDENTITY_CODE": [("hetu", "131052-308T"), ("x", "131052-308A"), ("x", "131052X308T")],
    "TH_TNIN": [("tnin", "1101700230252"), ("x", "1-1017-00230-25-2"), ("x", "1101700230251")],
}


def rows() -> list[tuple[int, str]]:
    """(doc_id, text): ids fall from -1."""
    texts = [f"{before} {value} end" if value else before for pairs in VALUES.values() for before, value in pairs]
    return [(-1 - i, t) for i, t in enumerate(texts)]
