"""The built-in recognizers: their patterns, scores, context words and checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Recognizer:
    """patterns: (score, regular expression in RE2 syntax, group that is the span). labels: words one of which must precede a span closely. lookaround: patterns may use look-around; those that the JVM can't be shown to run in time that follows the text's size run in an engine that has it, bounded in time. validator: the name of a check, or a function from the span's text to a condition; spans that meet it score 1, others go. accepts: a function from a span (start, end, text, and before, the text that precedes it) to a condition; others go."""

    entity: str
    name: str
    language: str
    patterns: list[tuple[float, str, int]]
    context: list[str] = field(default_factory=list)
    validator: str | Callable | None = None
    labels: list[str] = field(default_factory=list)
    lookaround: bool = False
    accepts: Callable | None = None

    def supports(self, entities: list[str] | None) -> bool:
        return entities is None or self.entity in entities


#: Fixed value: the pattern of a mail address.
EMAIL = r"\b((([!#$%&'*+\-/=?^_`{|}~\w])|([!#$%&'*+\-/=?^_`{|}~\w][!#$%&'*+\-/=?^_`{|}~\.\w]{0,}[!#$%&'*+\-/=?^_`{|}~\w]))[@]\w+([-.]\w+)*\.\w+([-.]\w+)*)\b"

#: Fixed values, in the order that decides between equal spans.
RECOGNIZERS = [
    Recognizer("EMAIL_ADDRESS", "EmailRecognizer", "en", [(0.5, EMAIL, 0)], ["email", "mail"], None, []),
    Recognizer("PHONE_NUMBER", "PhoneRecognizer", "en", [(0.5, r"(?:^|\W)((?:\+?1[-.\p{Zs}]?)?(?:\(\d{3}\)|\d{3})[-.\p{Zs}]?\d{3}[-.\p{Zs}]?\d{4})\b", 1), (0.5, r"\B\+(?:[\p{Zs}.()-]{0,2}\d){8,15}\b", 0), (0.5, r"(?:^|\W)((?:\+?55[\p{Zs}.-]?)?(?:\(\d{2}\)|\d{2})[\p{Zs}.-]?9?\d{4}[\p{Zs}.-]?\d{4})\b", 1)], ["phone", "number", "telephone", "cell", "mobile"], None, []),
    Recognizer("CREDIT_CARD", "CreditCardRecognizer", "en", [(0.3, r"\b((4\d{3})|(5[0-5]\d{2})|(6\d{3})|(3\d{3}))[- ]?(\d{3,4})[- ]?(\d{3,4})[- ]?(\d{3,5})\b", 0)], ["credit", "card", "visa", "mastercard", "cc", "amex", "discover"], "luhn", []),
    Recognizer("CRYPTO", "CryptoRecognizer", "en", [(0.5, r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b", 0), (0.5, r"\b0x[a-fA-F0-9]{40}\b", 0)], ["wallet", "bitcoin", "btc", "ethereum", "eth"], None, []),
    Recognizer("IP_ADDRESS", "IpRecognizer", "en", [(0.6, r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", 0), (0.6, r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", 0)], ["ip", "address", "ipv4", "ipv6"], None, []),
    Recognizer("URL", "UrlRecognizer", "en", [(0.5, r"\b(?:https?://|ftp://|www\.)[^\s/$.?#][^\s][^\s]*\b", 0)], ["url", "link", "website"], None, []),
    Recognizer("DATE_TIME", "DateTimeRecognizer", "en", [(0.6, r"\b(0?[1-9]|1[0-2])[/-](0?[1-9]|[12]\d|3[01])[/-](\d{4})\b", 0), (0.7, r"\b(\d{4})-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])\b", 0), (0.8, r"\b(January|February|March|April|May|June|July|August|September|October|November|December)\p{Zs}+(\d{1,2}),?\p{Zs}+(\d{4})\b", 0), (0.7, r"\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\.?\p{Zs}+(\d{1,2}),?\p{Zs}+(\d{4})\b", 0)], ["date", "born", "birthday", "dob"], None, []),
    Recognizer("IBAN_CODE", "IbanRecognizer", "en", [(0.3, r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{1,30}\b", 0), (0.4, r"\b([A-Z]{2}[0-9]{2}\p{Zs}?([A-Z0-9]{4}\p{Zs}?){1,7}[A-Z0-9]{1,4})\b", 0)], ["iban", "account", "bank"], "iban", []),
    Recognizer("US_SSN", "UsSsnRecognizer", "en", [(0.85, r"\b\d{3}-\d{2}-\d{4}\b", 0), (0.3, r"\b\d{9}\b", 0)], ["ssn", "social", "security", "social security"], "ssn", []),
    Recognizer("US_ITIN", "UsItinRecognizer", "en", [(0.85, r"\b(9\d{2})-(\d{2})-(\d{4})\b", 0), (0.3, r"\b9\d{8}\b", 0)], ["itin", "taxpayer", "tax"], "itin", []),
    Recognizer("US_PASSPORT", "UsPassportRecognizer", "en", [(0.3, r"\b[0-9]{9}\b", 0), (0.4, r"\b[A-Z][0-9]{8}\b", 0)], ["passport", "travel", "document"], None, []),
    Recognizer("US_DRIVER_LICENSE", "UsDriverLicenseRecognizer", "en", [(0.3, r"\b[A-Z]{1,2}[0-9]{5,9}\b", 0), (0.5, r"\b[A-Z][0-9]{7}\b", 0), (0.5, r"\b[A-Z][0-9]{12}\b", 0)], ["driver", "license", "dl", "drivers"], None, []),
    Recognizer("US_BANK_NUMBER", "UsBankRecognizer", "en", [(0.05, r"\b\d{8,17}\b", 0)], ["account", "bank", "routing"], None, []),
    Recognizer("ABA_ROUTING", "AbaRoutingRecognizer", "en", [(0.5, r"\b\d{9}\b", 0)], ["routing", "aba", "transit"], "aba", []),
    Recognizer("MEDICAL_LICENSE", "MedicalLicenseRecognizer", "en", [(0.4, r"\b[A-Z]{1,2}\d{4,8}\b", 0)], ["medical", "license", "physician", "doctor"], None, []),
    Recognizer("UK_NHS", "UkNhsRecognizer", "en", [(0.6, r"\b\d{3}\p{Zs}?\d{3}\p{Zs}?\d{4}\b", 0)], ["nhs", "health"], "nhs", []),
    Recognizer("UK_NINO", "UkNinoRecognizer", "en", [(0.7, r"\b[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\p{Zs}?\d{2}\p{Zs}?\d{2}\p{Zs}?\d{2}\p{Zs}?[A-D]\b", 0)], ["nino", "national insurance"], "nino", []),
    Recognizer("AU_TFN", "AuTfnRecognizer", "en", [(0.3, r"\b\d{3}\p{Zs}?\d{3}\p{Zs}?\d{3}\b", 0)], ["tfn", "tax file"], "tfn", []),
    Recognizer("AU_ABN", "AuAbnRecognizer", "en", [(0.3, r"\b\d{2}\p{Zs}?\d{3}\p{Zs}?\d{3}\p{Zs}?\d{3}\b", 0)], ["abn", "business number"], "abn", []),
    Recognizer("AU_ACN", "AuAcnRecognizer", "en", [(0.3, r"\b\d{3}\p{Zs}?\d{3}\p{Zs}?\d{3}\b", 0)], ["acn", "company number"], "acn", []),
    Recognizer("AU_MEDICARE", "AuMedicareRecognizer", "en", [(0.6, r"\b\d{4}\p{Zs}?\d{5}\p{Zs}?\d{1}\b", 0)], ["medicare", "health"], "medicare", []),
    Recognizer("IN_AADHAAR", "InAadhaarRecognizer", "en", [(0.6, r"\b\d{4}\p{Zs}?\d{4}\p{Zs}?\d{4}\b", 0)], ["aadhaar", "aadhar"], "aadhaar", []),
    Recognizer("IN_PAN", "InPanRecognizer", "en", [(0.85, r"\b[A-Z]{5}\d{4}[A-Z]\b", 0)], ["pan", "permanent account"], None, []),
    Recognizer("IN_PASSPORT", "InPassportRecognizer", "en", [(0.6, r"\b[A-Z]\d{7}\b", 0)], ["passport", "travel"], None, []),
    Recognizer("IN_VEHICLE_REGISTRATION", "InVehicleRecognizer", "en", [(0.6, r"\b[A-Z]{2}\p{Zs}?\d{1,2}\p{Zs}?[A-Z]{1,2}\p{Zs}?\d{4}\b", 0)], ["vehicle", "registration", "car"], None, []),
    Recognizer("IN_VOTER", "InVoterRecognizer", "en", [(0.6, r"\b[A-Z]{3}\d{7}\b", 0)], ["voter", "epic"], None, []),
    Recognizer("IN_GSTIN", "InGstinRecognizer", "en", [(0.85, r"\b\d{2}[A-Z]{5}\d{4}[A-Z][A-Z\d]Z[A-Z\d]\b", 0)], ["gstin", "gst"], None, []),
    Recognizer("IT_FISCAL_CODE", "ItFiscalCodeRecognizer", "it", [(0.85, r"\b[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]\b", 0)], ["codice fiscale", "fiscal"], "it_fiscal", []),
    Recognizer("IT_VAT_CODE", "ItVatRecognizer", "it", [(0.3, r"\b\d{11}\b", 0)], ["vat", "iva", "partita iva"], "it_vat", []),
    Recognizer("IT_IDENTITY_CARD", "ItIdentityCardRecognizer", "it", [(0.7, r"\b[A-Z]{2}\d{5}[A-Z]{2}\b", 0), (0.3, r"\b[A-Z0-9]{7}\b", 0)], ["identity", "carta identita"], None, []),
    Recognizer("IT_DRIVER_LICENSE", "ItDriverLicenseRecognizer", "it", [(0.6, r"\b[A-Z]{2}\d{7}[A-Z]\b", 0)], ["patente", "driver"], None, []),
    Recognizer("IT_PASSPORT", "ItPassportRecognizer", "it", [(0.6, r"\b[A-Z]{2}\d{7}\b", 0)], ["passport", "passaporto"], None, []),
    Recognizer("ES_NIF", "EsNifRecognizer", "es", [(0.7, r"\b\d{8}[A-Z]\b", 0)], ["nif", "dni"], "es_nif", []),
    Recognizer("ES_NIE", "EsNieRecognizer", "es", [(0.7, r"\b[XYZ]\d{7}[A-Z]\b", 0)], ["nie", "extranjero"], "es_nie", []),
    Recognizer("SG_FIN", "SgFinRecognizer", "en", [(0.7, r"\b[FGM]\d{7}[A-Z]\b", 0)], ["fin", "singapore"], "sg_fin", []),
    Recognizer("SG_UEN", "SgUenRecognizer", "en", [(0.5, r"\b\d{8,9}[A-Z]\b", 0), (0.7, r"\b[A-Z]{1}\d{2}[A-Z]{2}\d{4}[A-Z]\b", 0)], ["uen", "singapore", "company"], None, []),
    Recognizer("BR_CPF", "BrCpfRecognizer", "pt", [(0.4, r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b", 0), (0.3, r"\b\d{11}\b", 0)], ["cpf", "cadastro de pessoas físicas"], "cpf", []),
    Recognizer("BR_CNPJ", "BrCnpjRecognizer", "pt", [(0.4, r"\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b", 0), (0.3, r"\b\d{14}\b", 0)], ["cnpj", "cadastro nacional"], "cnpj", []),
    Recognizer("BR_RG", "BrRgRecognizer", "pt", [(0.4, r"\b\d{1,2}\.\d{3}\.\d{3}-[0-9Xx]\b", 0)], ["rg", "registro geral", "identidade", "carteira de identidade"], None, []),
    Recognizer("BR_CNH", "BrCnhRecognizer", "pt", [(0.3, r"\b\d{11}\b", 0)], ["cnh", "habilitação", "carteira de motorista"], "cnh", []),
    Recognizer("BR_PIS", "BrPisRecognizer", "pt", [(0.4, r"\b\d{3}\.\d{5}\.\d{2}-\d\b", 0), (0.3, r"\b\d{11}\b", 0)], ["pis", "pasep", "nis", "nit"], "pis", []),
    Recognizer("BR_CNS", "BrCnsRecognizer", "pt", [(0.4, r"\b\d{3} \d{4} \d{4} \d{4}\b", 0), (0.3, r"\b\d{15}\b", 0)], ["cns", "cartão nacional de saúde", "cartao nacional de saude", "sus"], "cns", []),
    Recognizer("BR_TITULO_ELEITORAL", "BrTituloEleitoralRecognizer", "pt", [(0.4, r"\b\d{4} \d{4} \d{4}\b", 0), (0.3, r"\b\d{12}\b", 0)], ["título", "titulo", "eleitor", "eleitoral", "tse"], "titulo", []),
    Recognizer("BR_RENAVAM", "BrRenavamRecognizer", "pt", [(0.3, r"\b\d{11}\b", 0)], ["renavam", "veículo", "veiculo", "detran", "crlv"], "renavam", []),
    Recognizer("BR_CEP", "BrCepRecognizer", "pt", [(0.5, r"\b\d{5}-\d{3}\b", 0)], ["cep", "código postal", "codigo postal", "endereço", "endereco"], None, []),
    Recognizer("BR_CEP", "BrCepUnformattedRecognizer", "pt", [(0.8, r"\b\d{8}\b", 0)], [], None, ["cep", "codigo postal", "código postal", "postal code", "zip"]),
    Recognizer("BR_PLACA", "BrPlacaRecognizer", "pt", [(0.6, r"(?i)\b[a-z]{3}\d[a-z]\d{2}\b", 0), (0.6, r"(?i)\b[a-z]{3}-\d{4}\b", 0)], ["placa", "veículo", "veiculo", "carro"], None, []),
    Recognizer("BR_PIX_KEY", "BrPixKeyRecognizer", "pt", [(0.8, r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-4[0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}\b", 0)], [], None, ["pix", "evp", "chave pix"]),
    Recognizer("PL_PESEL", "PlPeselRecognizer", "pl", [(0.3, r"\b\d{11}\b", 0)], ["pesel"], "pesel", []),
    Recognizer("KR_RRN", "KrRrnRecognizer", "ko", [(0.7, r"\b\d{6}-\d{7}\b", 0)], ["주민등록번호", "rrn"], "kr_rrn", []),
    Recognizer("FI_PERSONAL_IDENTITY_CODE", "FiPersonalCodeRecognizer", "fi", [(0.85, r"\b\d{6}[-+A]\d{3}[0-9A-FHJ-NPR-Y]\b", 0)], ["henkilötunnus", "hetu"], "fi_code", []),
    Recognizer("TH_TNIN", "ThTninRecognizer", "th", [(0.3, r"\b\d{13}\b", 0), (0.85, r"\b\d-\d{4}-\d{5}-\d{2}-\d\b", 0)], ["บัตรประชาชน", "tnin"], "th_tnin", []),
]


def supported_entities(recognizers: list[Recognizer] = RECOGNIZERS) -> list[str]:
    return sorted({r.entity for r in recognizers})
