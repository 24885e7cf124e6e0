"""Fixed values of the detection rules.

Patterns, word lists, markers and confidences below must be exactly these for results to be
right. They are data: no logic lives here.
"""

from __future__ import annotations

from dataclasses import dataclass

SCAN_CHARS = 200_000
SIGNALS_PER_DOCUMENT = 32
EXTRACTED_CHARS = 300_000
SNIPPET_CHARS = 180

# --- pattern rules, in order of acceptance -----------------------------------------------------

EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
IBAN = r"\b[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]){11,30}\b"
PHONE = r"\b(?:\+\d{1,3}[ -]?)?(?:\(?\d{2,4}\)?[ -]?){2,4}\d{2,4}\b"
EMPLOYEE_ID = r"\b(?:EMP|EE|E)-\d{3,8}\b"
TAX_ID = r"\b(?:tax|vat)\s*id\s*[:#]?\s*[A-Z0-9 -]{6,20}\b"
AMOUNT = (
    r"\b(?:EUR|USD|GBP|CHF)\s?\d{1,6}(?:[,.]\d{2})?\b"
    r"|\b\d{1,6}(?:[,.]\d{2})\s?(?:EUR|USD|GBP|CHF)\b"
)
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
UK_NINO = r"\b(?!BG|GB|KN|NK|NT|TN|ZZ)[A-CEGHJ-PR-TW-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
IPV6 = r"\b(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{1,4}\b"
MAC = r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b"
UUID = r"\b[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[1-5][0-9A-Fa-f]{3}-[89ABab][0-9A-Fa-f]{3}-[0-9A-Fa-f]{12}\b"
PAYMENT_CARD = r"\b(?:\d[ -]*?){13,19}\b"
GEO = (
    r"\b[-+]?(?:[1-8]?\d(?:\.\d+)?|90(?:\.0+)?)\s*,\s*"
    r"[-+]?(?:1[0-7]\d(?:\.\d+)?|[1-9]?\d(?:\.\d+)?|180(?:\.0+)?)\b"
)
URL = r"""\bhttps?://[^\s<>()"']{6,}\b"""
HANDLE = r"(?<![A-Za-z0-9._%+-])@[A-Za-z0-9_]{3,30}\b"

DATE_LIKE = r"(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})"
LONG_DIGITS = r"\b\d(?:[ -]?\d){7,}\b"
PASSPORT_VALUE = r"\b(?=[A-Z0-9]{6,15}\b)(?=[A-Z0-9]*\d)[A-Z]{1,3}[A-Z0-9]{5,12}\b"
HANDLE_VALUE = r"[A-Za-z][A-Za-z0-9._-]{2,63}"


@dataclass(frozen=True)
class PatternRule:
    name: str
    signal_type: str
    detector: str
    marker: str
    confidence: float
    pattern: str
    ignore_case: bool = False
    needs: str = ""  # every match contains this simpler, cheaper pattern


PATTERN_RULES = (
    PatternRule("email", "email", "email_pattern", "[REDACTED_EMAIL]", 0.91, EMAIL, needs="@"),
    PatternRule("iban", "iban_like", "iban_like_pattern", "[REDACTED_FINANCIAL_ID]", 0.91, IBAN, needs=r"[A-Z]{2}\d{2}"),
    PatternRule("phone", "phone_number", "phone_number_pattern", "[REDACTED_PHONE]", 0.88, PHONE, needs=r"\d{2}"),
    PatternRule("employee_id", "employee_id", "employee_id_pattern", "[REDACTED_EMPLOYEE_ID]", 0.87, EMPLOYEE_ID, True,
                needs=r"-\d{3}"),
    PatternRule("tax_id", "tax_id", "tax_id_pattern", "[REDACTED_TAX_ID]", 0.84, TAX_ID, True,
                needs=r"[aA][xXtT]\s*[iIİı][dD]"),
    PatternRule("amount", "expense_amount", "currency_amount_pattern", "[REDACTED_AMOUNT]", 0.82, AMOUNT,
                needs="EUR|USD|GBP|CHF"),
    PatternRule("ssn", "national_identifier", "ssn_pattern", "[REDACTED_NATIONAL_ID]", 0.88, SSN, needs=r"-\d{2}-"),
    PatternRule("uk_nino", "national_identifier", "uk_nino_pattern", "[REDACTED_NATIONAL_ID]", 0.83, UK_NINO, True,
                needs=r"\d{2}\s?\d{2}\s?\d{2}\s?[A-Da-d]"),
    PatternRule("ipv4", "online_identifier", "ipv4_pattern", "[REDACTED_IP_ADDRESS]", 0.8, IPV4,
                needs=r"\.\d{1,3}\."),
    PatternRule("ipv6", "online_identifier", "ipv6_pattern", "[REDACTED_IP_ADDRESS]", 0.76, IPV6,
                needs=":[0-9A-Fa-f]{1,4}:"),
    PatternRule("mac", "device_identifier", "mac_address_pattern", "[REDACTED_DEVICE_ID]", 0.84, MAC,
                needs="[:-][0-9A-Fa-f]{2}[:-]"),
    PatternRule("uuid", "online_identifier", "uuid_pattern", "[REDACTED_ONLINE_ID]", 0.76, UUID,
                needs="-[1-5][0-9A-Fa-f]{3}-"),
    PatternRule("payment_card", "payment_card", "payment_card_luhn_pattern", "[REDACTED_PAYMENT_CARD]", 0.9, PAYMENT_CARD,
                needs=r"(?:\d[ -]*){13}"),
    PatternRule("geo", "location_data", "geo_coordinate_pattern", "[REDACTED_LOCATION]", 0.82, GEO, needs=r",\s*[-+]?\d"),
    PatternRule("url", "url", "url_pattern", "[REDACTED_URL]", 0.68, URL, True, needs="://"),
    PatternRule("handle", "account_handle", "account_handle_pattern", "[REDACTED_HANDLE]", 0.7, HANDLE, needs="@"),
)

PHONE_CONTEXT_CHARS = 32
PHONE_WORDS = (
    "phone", "mobile", "tel", "telephone", "telefon", "téléphone", "teléfono", "telefone",
    "telefoon", "電話", "电话", "전화", "الهاتف",
)
AMOUNT_CONTEXT_CHARS = 48
AMOUNT_WORDS = (
    "salary", "salaris", "salario", "gehalt", "compensation", "payroll", "bonus", "wage",
    "expense", "reimbursement", "claim", "allowance", "employee", "staff", "participant",
    "requester", "traveler",
)
URL_HINTS = (
    "/user/", "/users/", "/profile/", "/profiles/", "/account/", "/people/", "linkedin.com/in/",
    "github.com/", "x.com/", "twitter.com/",
)

# A weaker type is not accepted where it overlaps one of these stronger types.
STRONGER_TYPES = {
    "expense_amount": ("salary_compensation",),
    "iban_like": ("bank_account",),
    "phone_number": (
        "bank_account", "date_of_birth", "employee_id", "national_identifier",
        "passport_number", "payment_card", "tax_id",
    ),
}

PLACEHOLDER_VALUES = ("n/a", "na", "none", "select", "select one", "choose one", "pending", "todo")

# --- label rules, first match wins -------------------------------------------------------------


@dataclass(frozen=True)
class LabelRule:
    signal_type: str
    detector: str
    marker: str
    confidence: float
    words: tuple[str, ...]
    test: str = "contains"  # contains | equals | passport | employee | handle | person


MULTILINGUAL_RULES = (
    LabelRule("organization_identifier", "multilingual_organization_label", "[REDACTED_ORGANIZATION]", 0.7, (
        "公司", "单位", "组织", "empresa", "societe", "entreprise", "firma", "azienda", "bedrijf",
        "organisatie", "会社", "회사", "المؤسسة", "empresa proveedor")),
    LabelRule("person_name", "multilingual_person_label", "[REDACTED_PERSON_NAME]", 0.8, (
        "姓名", "名字", "联系人", "负责人", "旅客", "乘客", "nombre completo", "nombre", "nom", "prenom",
        "vorname", "nachname", "reisender", "passagier", "nome", "naam", "imie", "nazwisko", "氏名",
        "お名前", "이름", "الاسم")),
    LabelRule("email", "multilingual_email_label", "[REDACTED_EMAIL]", 0.86, (
        "邮箱", "电子邮件", "邮件", "correo electronico", "correo", "courriel", "e-mail", "メール",
        "이메일", "البريد الالكتروني", "البريد الإلكتروني")),
    LabelRule("phone_number", "multilingual_phone_label", "[REDACTED_PHONE]", 0.84, (
        "电话", "手机号", "手机", "联系电话", "telefono", "telephone", "teléfono", "téléphone",
        "telefone", "telefoon", "telefon", "携帯", "電話", "전화", "الهاتف", "الجوال")),
    LabelRule("date_of_birth", "multilingual_birth_date_label", "[REDACTED_DATE_OF_BIRTH]", 0.86, (
        "出生日期", "生日", "出生", "fecha de nacimiento", "date de naissance", "geburtsdatum",
        "data di nascita", "data de nascimento", "geboortedatum", "data urodzenia", "生年月日",
        "생년월일", "تاريخ الميلاد")),
    LabelRule("national_identifier", "multilingual_national_id_label", "[REDACTED_NATIONAL_ID]", 0.86, (
        "身份证", "身份证号", "证件号码", "证件号", "dni", "nie", "cpf", "bsn", "pesel",
        "numero de identidad", "numéro d'identification", "numero d identification", "ausweisnummer",
        "マイナンバー", "주민등록번호", "رقم الهوية")),
    LabelRule("tax_id", "multilingual_tax_id_label", "[REDACTED_TAX_ID]", 0.84, (
        "codice fiscale", "nif", "numero fiscal", "numero de identificacao fiscal", "steuer id",
        "steueridentifikation", "税番号", "납세자 번호", "الرقم الضريبي")),
    LabelRule("passport_number", "multilingual_passport_label", "[REDACTED_PASSPORT]", 0.87, (
        "护照", "护照号", "护照号码", "pasaporte", "passeport", "reisepass", "passaporto", "paspoort",
        "paszport", "パスポート", "여권", "جواز السفر")),
    LabelRule("driver_license", "multilingual_driver_license_label", "[REDACTED_DRIVER_LICENSE]", 0.84, (
        "驾驶证", "驾照", "驾驶证号", "驾照号码", "führerschein", "fuehrerschein",
        "licencia de conducir", "permiso de conducir", "permis de conduire", "patente di guida",
        "carta de condução", "rijbewijs", "운전면허", "運転免許")),
    LabelRule("signature", "multilingual_signature_label", "[REDACTED_SIGNATURE]", 0.78, (
        "签名", "签字", "unterschrift", "assinatura", "署名", "서명", "التوقيع")),
    LabelRule("travel_record", "multilingual_travel_label", "[REDACTED_TRAVEL_RECORD]", 0.76, (
        "预订编号", "订票号", "行程编号", "常旅客号", "buchungsnummer", "reservierungscode", "pnr",
        "numero de reserva", "numéro de réservation", "codice prenotazione", "旅程番号", "예약 번호")),
    LabelRule("address", "multilingual_address_label", "[REDACTED_ADDRESS]", 0.79, (
        "地址", "住址", "家庭住址", "direccion", "dirección", "adresse", "anschrift", "indirizzo",
        "endereco", "endereço", "adres", "住所", "주소", "العنوان")),
    LabelRule("bank_account", "multilingual_bank_label", "[REDACTED_BANK_ACCOUNT]", 0.84, (
        "银行账号", "银行账户", "账号", "cuenta bancaria", "compte bancaire", "bankkonto",
        "conto bancario", "conta bancaria", "bankrekening", "konto bankowe", "銀行口座", "계좌",
        "الحساب البنكي")),
    LabelRule("medical_identifier", "multilingual_medical_id_label", "[REDACTED_MEDICAL_ID]", 0.86, (
        "病历号", "患者编号", "医保号", "numero de paciente", "dossier medical", "numéro patient",
        "patienten nummer", "numero paziente", "numero do paciente", "patientnummer", "患者番号",
        "رقم المريض")),
    LabelRule("health_data", "multilingual_health_label", "[REDACTED_HEALTH_DATA]", 0.82, (
        "诊断", "病情", "过敏史", "diagnostico", "diagnóstico", "diagnostic", "diagnose", "diagnosi",
        "diagnoza", "allergie", "アレルギー", "진단", "التشخيص")),
    LabelRule("salary_compensation", "multilingual_compensation_label", "[REDACTED_COMPENSATION]", 0.8, (
        "薪资", "工资", "奖金", "salario", "salaire", "gehalt", "bonus", "stipendio", "salaris",
        "wynagrodzenie", "給与", "급여", "الراتب")),
    LabelRule("credential_secret", "multilingual_secret_label", "[REDACTED_SECRET]", 0.76, (
        "密码", "口令", "密钥", "令牌", "contrasena", "contraseña", "mot de passe", "passwort", "senha",
        "palavra passe", "wachtwoord", "haslo", "パスワード", "비밀번호", "كلمة المرور")),
)

ENGLISH_RULES = (
    LabelRule("email", "email_label", "[REDACTED_EMAIL]", 0.86, ("email",)),
    LabelRule("phone_number", "phone_label", "[REDACTED_PHONE]", 0.84, ("phone", "mobile")),
    LabelRule("date_of_birth", "date_of_birth_label", "[REDACTED_DATE_OF_BIRTH]", 0.86,
              ("date of birth", "birth date", "dob", "born")),
    LabelRule("tax_id", "tax_id_label", "[REDACTED_TAX_ID]", 0.84, ("tax", "vat")),
    LabelRule("passport_number", "passport_label", "[REDACTED_PASSPORT]", 0.87, ("passport",), "passport"),
    LabelRule("driver_license", "driver_license_label", "[REDACTED_DRIVER_LICENSE]", 0.84,
              ("driver license", "driving licence", "drivers license", "license number", "licence number")),
    LabelRule("national_identifier", "national_identifier_label", "[REDACTED_NATIONAL_ID]", 0.86,
              ("national id", "identity number", "identification number", "ssn", "social security", "nino")),
    LabelRule("government_identifier", "government_identifier_label", "[REDACTED_GOVERNMENT_ID]", 0.82,
              ("government id", "resident permit", "visa number", "citizen id")),
    LabelRule("student_identifier", "student_identifier_label", "[REDACTED_STUDENT_ID]", 0.82,
              ("student id", "student number", "learner id")),
    LabelRule("medical_identifier", "medical_identifier_label", "[REDACTED_MEDICAL_ID]", 0.86,
              ("medical record", "patient id", "health insurance", "insurance id", "nhs number")),
    LabelRule("employee_id", "employee_id_label", "[REDACTED_EMPLOYEE_ID]", 0.85,
              ("employee id", "staff id", "personnel number", "worker id"), "employee"),
    LabelRule("payment_card", "payment_card_label", "[REDACTED_PAYMENT_CARD]", 0.86,
              ("credit card", "card number", "payment card")),
    LabelRule("bank_account", "bank_account_label", "[REDACTED_BANK_ACCOUNT]", 0.84,
              ("bank account", "account number", "routing number", "sort code", "bic", "swift")),
    LabelRule("iban_like", "iban_label", "[REDACTED_FINANCIAL_ID]", 0.88, ("iban",)),
    LabelRule("salary_compensation", "compensation_label", "[REDACTED_COMPENSATION]", 0.8,
              ("salary", "compensation", "payroll", "bonus", "wage")),
    LabelRule("expense_amount", "amount_label", "[REDACTED_AMOUNT]", 0.82,
              ("expense", "reimbursement", "receipt", "claim", "allowance")),
    LabelRule("online_identifier", "online_identifier_label", "[REDACTED_ONLINE_ID]", 0.78,
              ("ip address", "ipv4", "ipv6", "online identifier", "cookie id", "advertising id", "tracking id")),
    LabelRule("device_identifier", "device_identifier_label", "[REDACTED_DEVICE_ID]", 0.8,
              ("device id", "imei", "serial number", "mac address", "hardware id")),
    LabelRule("address", "address_label", "[REDACTED_ADDRESS]", 0.79, ("address",)),
    LabelRule("location_data", "location_label", "[REDACTED_LOCATION]", 0.8,
              ("location", "gps", "latitude", "longitude", "geo")),
    LabelRule("license_plate", "license_plate_label", "[REDACTED_LICENSE_PLATE]", 0.78,
              ("license plate", "licence plate", "registration plate", "vehicle registration", "plate number")),
    LabelRule("account_handle", "account_handle_label", "[REDACTED_HANDLE]", 0.76,
              ("username", "user name", "user id", "handle", "account id", "profile id", "login id")),
    LabelRule("account_handle", "account_handle_label", "[REDACTED_HANDLE]", 0.76, ("user",), "handle"),
    LabelRule("travel_record", "travel_record_label", "[REDACTED_TRAVEL_RECORD]", 0.76,
              ("booking reference", "reservation code", "pnr", "ticket number", "itinerary id",
               "travel booking", "frequent flyer")),
    LabelRule("signature", "signature_label", "[REDACTED_SIGNATURE]", 0.78,
              ("signature", "signed by", "signatory", "customer signature", "applicant signature",
               "employee signature"), "equals"),
    LabelRule("url", "url_label", "[REDACTED_URL]", 0.72,
              ("profile url", "personal url", "social link", "account url")),
    LabelRule("credential_secret", "credential_secret_label", "[REDACTED_SECRET]", 0.76,
              ("password", "passcode", "api key", "secret", "token", "session id", "cookie")),
    LabelRule("health_data", "health_data_label", "[REDACTED_HEALTH_DATA]", 0.82,
              ("diagnosis", "medical condition", "medication", "allergy", "disability", "sick leave",
               "health status", "doctor", "patient")),
    LabelRule("biometric_data", "biometric_data_label", "[REDACTED_BIOMETRIC_DATA]", 0.84,
              ("fingerprint", "face id", "facial recognition", "voiceprint", "iris", "retina", "biometric")),
    LabelRule("genetic_data", "genetic_data_label", "[REDACTED_GENETIC_DATA]", 0.84, ("dna", "genetic", "genome")),
    LabelRule("race_ethnicity", "race_ethnicity_label", "[REDACTED_RACE_ETHNICITY]", 0.8,
              ("race", "racial", "ethnicity", "ethnic origin")),
    LabelRule("political_opinion", "political_opinion_label", "[REDACTED_POLITICAL_DATA]", 0.8,
              ("political", "party membership", "political opinion")),
    LabelRule("religious_belief", "religious_belief_label", "[REDACTED_BELIEF_DATA]", 0.8,
              ("religion", "religious", "belief", "philosophical")),
    LabelRule("trade_union", "trade_union_label", "[REDACTED_UNION_DATA]", 0.8, ("trade union", "union membership")),
    LabelRule("sex_life_orientation", "sex_life_orientation_label", "[REDACTED_SEXUAL_ORIENTATION]", 0.8,
              ("sexual orientation", "sex life")),
    LabelRule("criminal_record", "criminal_record_label", "[REDACTED_CRIMINAL_RECORD]", 0.8,
              ("criminal", "conviction", "offence", "offense", "background check")),
    LabelRule("minor_data", "minor_data_label", "[REDACTED_MINOR_DATA]", 0.76,
              ("child", "minor", "guardian", "parent name")),
    LabelRule("family_data", "family_data_label", "[REDACTED_FAMILY_DATA]", 0.76,
              ("spouse", "dependent", "emergency contact", "next of kin", "family")),
    LabelRule("access_context", "access_context_label", "[REDACTED_ACCESS_CONTEXT]", 0.76,
              ("access", "system", "department", "role", "justification")),
    LabelRule("incident_context", "incident_context_label", "[REDACTED_INCIDENT_CONTEXT]", 0.76,
              ("incident", "description", "root cause", "corrective action", "deadline", "location", "impact")),
    LabelRule("free_text_personal_context", "free_text_context_label", "[REDACTED_FREE_TEXT]", 0.74,
              ("comment", "recommendation", "feedback", "evaluation")),
    LabelRule("person_name", "person_label", "[REDACTED_PERSON_NAME]", 0.78,
              ("name", "employee", "participant", "manager", "approver", "reviewer", "owner", "requester",
               "reported by", "passenger", "traveler", "traveller", "contact person", "trainer"), "person"),
    LabelRule("organization_identifier", "organization_label", "[REDACTED_ORGANIZATION]", 0.7,
              ("company", "supplier")),
)

NOT_A_PERSON_LABEL = ("team", "department", "group", "workstream", "queue", "service")
NOT_A_PERSON_VALUE = ("ltd", "llc", "gmbh", "inc", "limited")

# --- labels that may stand inside a line -------------------------------------------------------

MULTILINGUAL_WORDS = tuple(word for rule in MULTILINGUAL_RULES for word in rule.words)

INLINE_LABELS = (
    "account id", "account_id", "account number", "address", "advertising id", "allergy", "amount",
    "api key", "approver", "bank account", "bic", "birth date", "bonus", "card number", "citizen id",
    "comment", "compensation", "contact person", "cookie", "cookie id", "corrective action",
    "credit card", "date of birth", "date_of_birth", "deadline", "department", "device id",
    "diagnosis", "dob", "driver license", "driver_license", "driving licence", "email",
    "email_address", "emergency contact", "employee id", "evaluation", "expense", "feedback",
    "full name", "government id", "guardian", "health insurance", "home address", "iban",
    "identity number", "imei", "incident", "insurance id", "ip address", "ip_address",
    "justification", "latitude", "license number", "location", "longitude", "manager",
    "medical condition", "medical record", "mobile", "name", "national id", "next of kin",
    "nhs number", "passenger", "passenger name", "passport", "passport number", "passport_number",
    "password", "patient id", "payroll", "personnel number", "phone", "phone_number",
    "postal address", "profile id", "profile_id", "recommendation", "reimbursement", "reported by",
    "requester", "resident permit", "reviewer", "role", "salary", "secret", "serial number",
    "signature", "social security", "ssn", "staff id", "street address", "student id",
    "student number", "swift", "tax id", "telephone", "token", "tracking id", "booking reference",
    "booking_reference", "frequent flyer", "itinerary id", "pnr", "reservation code",
    "reservation_code", "ticket number", "ticket_number", "travel booking", "travel_booking",
    "traveler", "traveler name", "traveller", "traveller name", "user", "user id", "user_id",
    "user_name", "username", "vat id", "visa number", "worker id",
)

# Labels that may be followed by an equals sign.
EQUALS_LABELS = (
    "account id", "account number", "advertising id", "api key", "bank account", "bic",
    "booking reference", "cookie", "cookie id", "credit card", "date of birth", "device id",
    "driver license", "email", "email address", "employee id", "government id", "iban",
    "identity number", "imei", "ip address", "itinerary id", "license number", "login id", "mobile",
    "national id", "nhs number", "passport", "passport number", "password", "patient id",
    "personnel number", "phone", "phone number", "profile id", "reservation code", "secret",
    "serial number", "signature", "social security", "ssn", "staff id", "student id",
    "student number", "swift", "tax id", "telephone", "ticket number", "token", "tracking id",
    "travel booking", "user", "user id", "user name", "username", "vat id", "visa number", "worker id",
)

# Latin labels that may be followed by white space only.
WHITESPACE_LABELS = ("passport", "passport number", "passport_number")

# Labels that may stand alone on a line above their value.
STACKED_LABELS = (
    "account id", "account number", "address", "api key", "bank account", "bic", "birth date",
    "card number", "contact person", "credit card", "date of birth", "device id", "driver license",
    "driving licence", "email", "email address", "employee id", "full name", "government id",
    "home address", "iban", "identity number", "imei", "itinerary id", "license number", "login id",
    "mobile", "name", "national id", "passport", "passport number", "password", "patient id",
    "person name", "phone", "phone number", "postal address", "reservation code", "signature",
    "social security", "ssn", "street address", "tax id", "telephone", "ticket number", "token",
    "travel booking", "traveler", "traveller", "username", "vat id", "visa number",
)
STACKED_TYPES = (
    "account_handle", "address", "bank_account", "biometric_data", "credential_secret",
    "date_of_birth", "device_identifier", "driver_license", "email", "genetic_data",
    "government_identifier", "health_data", "iban_like", "medical_identifier", "minor_data",
    "national_identifier", "passport_number", "payment_card", "person_name", "phone_number",
    "signature", "student_identifier", "tax_id", "travel_record", "url",
)

# --- risk --------------------------------------------------------------------------------------

HIGH_RISK_TYPES = (
    "bank_account", "biometric_data", "credential_secret", "criminal_record", "date_of_birth",
    "driver_license", "employee_id", "free_text_personal_context", "genetic_data",
    "government_identifier", "health_data", "iban_like", "incident_context", "medical_identifier",
    "national_identifier", "passport_number", "payment_card", "political_opinion", "race_ethnicity",
    "religious_belief", "sex_life_orientation", "signature", "tax_id", "trade_union", "travel_record",
)
MEDIUM_RISK_TYPES = (
    "account_handle", "address", "email", "family_data", "license_plate", "location_data",
    "minor_data", "online_identifier", "organization_identifier", "phone_number",
    "salary_compensation", "student_identifier", "url", "device_identifier",
)

# --- plain-language copy: type -> (label, why it matters) ---------------------------------------

SIGNAL_COPY = {
    "address": ("address", "can identify or locate a person"),
    "bank_account": ("bank account", "can identify a person in a financial context"),
    "biometric_data": ("biometric data", "can indicate a special-category biometric context"),
    "credential_secret": ("credential secret", "can create access or account-takeover risk if exposed"),
    "date_of_birth": ("date of birth", "can identify a person when combined with other details"),
    "driver_license": ("driver licence number", "can directly identify a person through an official document"),
    "email": ("email address", "can identify or contact a person"),
    "employee_id": ("employee identifier", "can identify a worker inside an organisation"),
    "government_identifier": ("government identifier", "can directly identify a person through an official identifier"),
    "health_data": ("health data", "can indicate a special-category health context"),
    "iban_like": ("IBAN-like bank identifier", "can identify a person or account in a financial context"),
    "license_plate": ("licence plate", "can identify a vehicle linked to a person"),
    "location_data": ("location data", "can reveal where a person is or has been"),
    "medical_identifier": ("medical identifier", "can identify a person in a healthcare context"),
    "minor_data": ("minor-related data", "can indicate data about a child or young person"),
    "national_identifier": ("national identifier", "can directly identify a person through a state or employment identifier"),
    "online_identifier": ("online identifier", "can identify a person or browser over time"),
    "passport_number": ("passport number", "can directly identify a person through an official travel document"),
    "payment_card": ("payment card number", "can identify a person in a payment context"),
    "person_name": ("person name", "can identify a person when combined with file context"),
    "phone_number": ("phone number", "can identify or contact a person"),
    "political_opinion": ("political opinion indicator", "can indicate a special-category political-opinion context"),
    "race_ethnicity": ("race or ethnicity indicator", "can indicate a special-category race or ethnicity context"),
    "religious_belief": ("religious belief indicator", "can indicate a special-category religious-belief context"),
    "salary_compensation": ("salary or compensation detail", "can reveal employment or compensation information about a person"),
    "sex_life_orientation": ("sex life or orientation indicator", "can indicate a special-category sex life or orientation context"),
    "signature": ("signature", "can authenticate or identify a person"),
    "student_identifier": ("student identifier", "can identify a learner inside an education context"),
    "tax_id": ("tax identifier", "can directly identify a person in a tax or payroll context"),
    "trade_union": ("trade union indicator", "can indicate a special-category trade-union context"),
    "travel_record": ("travel record", "can reveal a person's movement or travel history"),
    "url": ("URL", "can point to an online profile, account, or resource linked to a person"),
}
OTHER_RELEVANCE = "may relate to an identifiable person"

# --- policy pack --------------------------------------------------------------------------------

POLICY_VERSION = "2026.05-demo"
CONTEXT_CATEGORIES = {
    "Expense_Report": "expense_report",
    "IT_Access_Request": "it_access",
    "Incident_Report": "incident_report",
    "Source_Documents": "source_documents",
    "Supplier_Onboarding": "supplier_onboarding",
    "Training_Evaluation": "training_evaluation",
}
RETENTION_RULES = (("supplier_onboarding", 1095), ("it_access", 730))
RISK_GUIDANCE = (
    ("supplier_onboarding", ("iban_like", "billing_address", "signature"), "high", 80,
     "Financial and signature identifiers require accountable human review."),
    ("it_access", ("employee_id", "email", "access_role"), "high", 80,
     "Identity and access-role evidence requires review before any action."),
    ("incident_report", ("email", "free_text_personal_data"), "medium", 60,
     "Incident context can contain personal descriptions and needs owner review."),
    ("expense_report", ("email", "employee_id", "reimbursement_data"), "medium", 55,
     "Expense records need business-context review before retention decisions."),
    ("training_evaluation", ("email", "feedback_comment"), "medium", 55,
     "Training feedback can include employee opinions and needs accountable review."),
)
