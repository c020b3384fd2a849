"""Word lists, tables and patterns that decide what is a detection."""

# Given names, surnames and words that end or bar a name, all folded to plain lower case.
GIVEN_NAMES = """
ada ahmet ali asli asya ayse aylin azra banu baran belgin berk beyza burak busra cagla can cem cemal cenk ceren damla
defne deniz derya didem duygu ebru ece ekin elif elisa emine emre enes esra eylul fatma feride fikret filiz gamze gozde
gul gulsah gulsen hande hasan hatice hazal hulya huseyin ibrahim ilayda ilknur ipek irem ismail jale kader kemal kerem
kubra lale leyla mahmut mehmet melis melisa melek merve mine miray murat mustafa nalan naz nehir nil nisa nur nurgul
omer onur osman ozge ozlem pelin perihan pinar ramazan recep reyhan rumeysa ruya salih seda selin sena serhat serkan
sevgi sevil sibel simge sude suleyman tolga tuba tugba tugce ugur ulku volkan yagmur yasemin yasin yeliz yunus yusuf
zafer zehra zeliha zeynep
""".split()
SURNAMES = """
acar aksoy aktas alkan altin arslan aslan ates avci aydin bayrak bulut cakir can celik cetin coskun demir demirci dogan
duman erdem erdogan eren ergin guler gunay gunes inanc isik kara karaca karaman kaya keles kilic koc kocak korkmaz kurt
ozer ozcan ozdemir ozkan ozturk polat sahin sari sezer simsek tan tekin tuna turan uysal uzun yalcin yaman yavuz yilmaz
yildirim yildiz yuce yucel
""".split()
NAME_STOPWORDS = """
adres ama and api area bir blackout blur bu card city copy customer data download email error file free from icin ile
image info key live local location name new password phone pixelate possible privacy pro ready region review
saved scan secret security select sensitive status support team test the token turkey turkiye user ve warning with zoom
""".split()
NAME_VALUE_STOPWORDS = NAME_STOPWORDS + "account book center contact details employee full guide holder office owner person profile recipient selector settings tools".split()
NAME_LABELS = [
    "account holder", "customer name", "employee name", "contact person", "profile name", "assigned to", "created by", "requested by", "approved by", "full name", "user name",
    "musteri adi", "calisan adi", "ilgili kisi", "hesap sahibi", "atanan kisi", "talep eden", "ad soyad", "customer", "employee", "contact", "recipient", "musteri", "calisan",
    "olusturan", "kullanici", "onaylayan", "owner", "soyad", "alici", "name", "user", "ad",
]
TITLES = "sayın|sayin|bay|bayan|sn|dr|prof|av|mr|mrs|ms|miss|sir|madam|bey|hanım|hanim"
NAME_SUFFIXES = "ndan nden nin nun dan den tan ten yla yle dir dur tir tur nda nde nca nce na ne yi yu in un da de ta te".split()

# Provinces (folded) and labels that introduce a place; values that are no place.
PROVINCES = """
adana adiyaman afyonkarahisar agri aksaray amasya ankara antalya ardahan artvin aydin balikesir bartin batman bayburt
bilecik bingol bitlis bolu burdur bursa canakkale cankiri corum denizli diyarbakir duzce edirne elazig erzincan erzurum
eskisehir gaziantep giresun gumushane hakkari hatay igdir isparta istanbul izmir kahramanmaras karabuk karaman kars
kastamonu kayseri kilis kirikkale kirklareli kirsehir kocaeli konya kutahya malatya manisa mardin mersin mugla mus
nevsehir nigde ordu osmaniye rize sakarya samsun sanliurfa siirt sinop sirnak sivas tekirdag tokat trabzon tunceli usak
van yalova yozgat zonguldak
""".split()
PLACE_LABELS = [
    "billing address", "shipping address", "postal address", "street address", "home address", "work address", "ip location", "postal code", "zip code", "fatura adresi",
    "teslimat adresi", "posta adresi", "sokak adresi", "ev adresi", "is adresi", "posta kodu", "location", "address", "country", "province", "region", "office", "state", "city",
    "konum", "adres", "sehir", "ulke", "ilce", "bolge", "ofis", "il",
]
PLACE_REJECTS = ["book", "guide", "selector", "settings", "tools"]
PLACE_CONTEXT_LABELS = "sehir|ilce|il|konum|adres|lokasyon|location|city|province|yer"

# IBAN lengths by country, and glyphs that scanners confuse.
IBAN_LENGTHS = {k: int(v) for k, v in (x.split(":") for x in """
AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BI:28 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DJ:27 DK:18 DO:28
EE:20 EG:29 ES:24 FI:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30
KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MR:27 MT:31 MU:30 NL:18 NO:15 PK:24 PL:28
PS:29 PT:25 QA:29 RO:24 RS:22 RU:33 SA:24 SC:31 SD:18 SE:24 SI:19 SK:24 SM:27 ST:25 SV:28 TL:23 TN:24 TR:26 UA:29 VA:22
VG:24 XK:20
""".split())}  # fmt: skip
LETTER_TO_DIGIT = ("OoIl|SsBb", "001115588")  # identity and tax numbers
IBAN_LETTER_TO_DIGIT = ("OISBZ", "01582")
IBAN_DIGIT_TO_LETTER = ("6015824", "GOISBZA")

# Top-level domains at which a glued address is cut.
TLDS = """
com net org edu gov io co tr uk de fr info biz app dev me us ca au nl se no fi ch at be it es pt pl ru jp kr cn in br
xyz online site store tech email cloud company network systems digital group global
""".split()

# Function words that seed phrases hold few of.
SEED_STOPWORDS = """
a an the and or but if then than that this these those to of in on for with as at by from into over under is are was
were be been being have has had do does did will would could should may might must can shall i you he she it we they me
him her us them my your his its our their not no yes so very just about above after again all also any because before
between both each few more most other some such only own same too up down out off here there when where why how what
which who whom while during through until once
""".split()

# Types, ranks and switches of the set-level operators.
ALWAYS_ON = ["tckn", "vkn", "credit_card", "iban", "private_key", "bearer_token", "connection_url", "env_secret", "passport", "seed_phrase"]
PROFILE = ["api_token", "email", "tckn", "vkn", "ipv4", "ipv6", "credit_card", "phone", "person_name", "location", "session_id", "ssn", "routing_number", "custom_rule"]
NEVER_SUPPRESSED = ["api_token", "tckn", "vkn", "email", "private_key", "bearer_token", "connection_url", "env_secret", "passport", "seed_phrase"]
WEAK = ["phone", "person_name", "location", "session_id"]
RANKS = {"api_token": 1, "email": 2, "tckn": 3, "vkn": 3, "ipv4": 4, "ipv6": 4, "credit_card": 5, "phone": 6, "person_name": 7, "location": 8, "session_id": 9}
OVERLAP = 0.45
LOW_CONFIDENCE = 70
PATTERN_TYPES = ["email", "phone", "ipv4", "ipv6", "vkn", "api_token", "session_id", "custom_rule", "env_secret", "passport", "bearer_token", "connection_url", "private_key", "ssn"]
LABELS = {
    "api_token": "Possible API token", "bearer_token": "Possible Bearer token", "connection_url": "Possible connection URL", "env_secret": "Possible .env secret",
    "passport": "Possible passport number", "seed_phrase": "Possible seed phrase", "email": "Possible email", "tckn": "Turkish ID Number", "vkn": "Tax ID Number",
    "person_name": "Possible name", "location": "Possible location", "ipv4": "Possible IP address", "ipv6": "Possible IPv6 address", "credit_card": "Possible card number",
    "phone": "Possible phone number", "session_id": "Possible session ID", "private_key": "Possible private key", "ssn": "Possible SSN", "routing_number": "Possible routing number", "iban": "Possible IBAN",
}
TOOLS = {
    "hide-api-key": ["api_token"], "blur-email": ["email"], "redact-phone-number": ["phone"], "hide-ip-address": ["ipv4", "ipv6"], "redact-credit-card": ["credit_card"],
    "hide-jwt-token": ["api_token"], "redact-ssn-pdf": ["ssn"], "anonymize-w2-tax-form": ["credit_card"], "blur-routing-number": ["routing_number"],
}
WARNINGS = [
    ("vkn_unverified", "unlabeled 10-digit number, checksum failed"),
    ("custom_id", "possible ID, verify"),
    ("short_secret", "This .env value is short. Confirm it before sharing."),
    ("passport_unlabeled", "Passport-like value without a Passport/Pasaport label. Confirm before redacting."),
    ("ssn_unlabeled", "9-digit number without an SSN label. Confirm before redacting."),
    ("routing_unverified", "Routing-number prefix matched, but the ABA checksum did not. Confirm before redacting."),
    ("seed", "Possible seed phrase. Review carefully before redacting."),
    ("iban_pattern_only", "This value matches an IBAN pattern, but its checksum was not validated."),
    ("iban_failed", "IBAN structure valid, checksum failed"),
    ("tckn_failed", "Shown because of a nearby identity label. The checksum did not match."),
    ("carrier_skipped", "Shown because of a phone label. The carrier prefix was not confirmed."),
    ("ocr_corrected", "OCR changed a character in this value. Compare it with the image."),
    ("truncated", "This credential looks incomplete. Confirm the full value before sharing."),
    ("contextual", "Suggested from surrounding context. This is not confirmed by a checksum."),
    ("low_ip", "OCR may have misread a digit. Verify the highlighted image area manually."),
    ("low", "OCR confidence is low. That percentage does not prove this value is correct."),
]

# Patterns. \b and \s stand for ASCII word boundaries and Unicode white space; patterns.py spells them out.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
IPV4 = rf"(?<![0-9])(?:{OCTET}\s*[.·•]\s*){{3}}{OCTET}(?::[0-9]{{1,5}})?(?![0-9])"  # scanners put blanks round dots
HEXTET = "[0-9a-f]{1,4}"
IPV6_FULL = f"(?:{HEXTET}:){{7}}{HEXTET}"
IPV6_SHORT = f"(?:{HEXTET}(?::{HEXTET}){{0,6}})?::(?:{HEXTET}(?::{HEXTET}){{0,6}})?"
IPV6 = rf"(?i)(?<![0-9a-f:])(?:\[(?:{IPV6_FULL}|{IPV6_SHORT})\]:[0-9]{{1,5}}|{IPV6_FULL}(?::[0-9]{{1,5}})?|{IPV6_SHORT})(?![0-9a-f:])"
CARD = r"(?<![0-9])(?:[0-9][ \t-]?){12,18}[0-9](?![0-9])"
SSN = r"(?<![0-9])[0-9]{3}[-\s–—][0-9]{2}[-\s–—][0-9]{4}(?![0-9])"
NINE_DIGITS = r"(?<![0-9])[0-9]{9}(?![0-9])"
TCKN = r"(?<![0-9])[0-9OoIl|SsBb]{11}(?![0-9])"
VKN = r"(?<![0-9OoIl|SsBb])[0-9OoIl|SsBb]{10}(?![0-9OoIl|SsBb])"
IBAN = r"(?<![A-Z0-9])(?:TR\s?[0-9]{2}(?:\s?[0-9]{4}){5}\s?[0-9]{2}|[A-Z]{2}[0-9]{2}(?:\s?[A-Z0-9]{4}){3,6}\s?[A-Z0-9]{1,4})(?![A-Z0-9])"
IBAN_DAMAGED = r"(?<![A-Z0-9])[A-Z0-9]{2}[0-9]{2}(?:\s?[A-Z0-9]{4}){3,6}\s?[A-Z0-9]{1,4}(?![A-Z0-9])"
CUSTOM_ID = r"(?i)\b(?:ID|REF|INV|CUS)[-_ ]?[0-9]{4,12}\b"
PHONES = [
    r"\+90[\s().-]*5[0-9]{2}(?:[\s().-]*[0-9]){7}\b",
    r"\+[0-9]{1,3}(?:[\s().-]*[0-9]){8,14}\b",
    r"\b0[\s.-]*5[0-9]{2}(?:[\s().-]*[0-9]){7}\b",
    r"\b0[\s.-]*[0-9]{2,4}(?:[\s().-]*[0-9]){6,12}\b",
    r"(?:^|\s)\([0-9]{2,4}\)(?:[\s.-]*[0-9]){7,14}\b",
]
API_TOKENS = [
    r"(?i)\bapi[_-]+(?:test|live)[_-]+[a-z0-9_-]{8,}\b",
    r"(?i)\bapi[_-]+(?:test|live)[_-]+[a-z0-9_-]{4,}(?:[ \t]+[a-z0-9_-]*[0-9][a-z0-9_-]*)+\b",
    r"(?i)\bghp_[a-z0-9]{20,}\b",
    r"(?i)\bghp_[a-z0-9]{8,}(?:[ \t]+[a-z0-9]*[0-9][a-z0-9]*)?\b",
    r"(?i)\bgh[pousr]_[a-z0-9]{36,}\b",
    r"(?i)\bgithub_pat_[a-z0-9_]{20,}\b",
    r"(?i)\bgithub_pat_[a-z0-9_]{8,}(?:[ \t]+[a-z0-9_]*[0-9][a-z0-9_]*)?\b",
    r"(?i)\bapi(?:test|live)[a-z0-9]{8,}\b",
    r"\beyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    r"\bsk-(?:proj-|admin-|[A-Za-z0-9]{20,})[A-Za-z0-9_-]+",
    r"(?<![A-Z0-9])(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{16}(?![A-Z0-9])",
]
AWS_SECRET = r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+=]{40}(?![A-Za-z0-9/+=])"
LONG_TOKEN = r"\b[A-Za-z0-9+/_=-]{40,}\b"
EXPLICIT_PREFIX = r"(?i)^(?:(?:sk|pk|rk)_(?:live|test)_|sk-(?:proj-|admin-)?|gh[pousr]_|github_pat_|api_(?:test|live)_|eyJ|(?:AKIA|ASIA|AROA|AIDA)|(?:mysql|mongodb(?:\+srv)?|redis|amqp|mssql|postgresql)://)"
CONNECTION_URL = r"(?i)\b(?:mysql|mongodb(?:\+srv)?|redis|amqp|mssql|postgresql)://[A-Za-z0-9._~+-]+:[^\x00@]+@[A-Za-z0-9.-]+\x00*(?::[0-9]{1,5})?(?:/[A-Za-z0-9._~+=/%-]*)?"
BEARER = r"(?i)\b(?:Authorization\s*:\s*)?(Bearer\s+([A-Za-z0-9._~+/=-]{16,}))"
ENV = r"""\b([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|(\S+))"""
ENV_KEY = r"(?i)(?:SECRET|TOKEN|PASSWORD|PASSWD|PWD|API_KEY|PRIVATE_KEY|ACCESS_KEY|CLIENT_SECRET)"
PASSPORT = r"(?is)\b(?>(?:Pasaport|Passport)(?:\s*No\.?)?\s*:?).*?\b([A-Z0-9]{5,9})\b"
KEY_HEADER = r"(?i)-{3,6}\s*B[E0]G[I1L]N(?:[ \t]+(?:RSA|EC|OPENSSH|ENCRYPTED|PRIVATE|KEY))+\s*-{0,6}"
KEY_END = r"-{3,6}\s*END(?:[ \t]+(?:RSA|EC|OPENSSH|ENCRYPTED|PRIVATE|KEY))+\s*-{0,6}"
KEY_LINES = 40
SESSIONS = [r"(?i)\b(?:sess|session)[_-]+[a-z0-9][a-z0-9_-]{5,}\b", r"(?i)\b(?:sess|session)[a-z0-9]{10,}\b"]
NAME_WORD = r"[A-Za-zÇĞİÖŞÜçğıöşü][A-Za-zÇĞİÖŞÜçğıöşü.'’-]{1,24}"
CAPITAL_WORD = r"[A-ZÇĞİÖŞÜ][A-Za-zÇĞİÖŞÜçğıöşü.'’-]{1,24}"
# What a second reading came to: a sound number, digits, or neither.
READINGS = ("valid-tckn", "CASE 2", "CASE 3")
# Types whose values scanners cut at the end: pieces that stand close go with them.
CUT_TYPES = ["api_token", "connection_url", "private_key", "bearer_token", "env_secret", "passport", "seed_phrase"]
