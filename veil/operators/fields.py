"""Form fields: sensitivity class, mask regions, canonical slot."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions.rules import BL, BR, WS
from veil.functions.spans import NO_SPANS, all_spans, cut_col
from veil.functions.util import settled, trim_ws
from veil.operators.detect import short_name
from veil.operators.regions import to_screenshot

# ---------------------------------------------------------------------------
# Vocabulary of sensitive form fields.
# ---------------------------------------------------------------------------
SAFE_INPUT_TYPES = ("button", "submit", "reset", "image", "checkbox", "radio", "file", "hidden")
TYPE_CATEGORY = (("password", "password"), ("email", "email"), ("tel", "phone"))
AUTOCOMPLETE_VALUES = (
    "current-password", "new-password", "one-time-code", "cc-number", "cc-csc", "cc-exp", "cc-exp-month",
    "cc-exp-year", "cc-type", "transaction-amount", "bday", "bday-day", "bday-month", "bday-year", "tel",
    "tel-national", "tel-country-code", "postal-code", "street-address", "address-line1", "address-line2",
    "address-level1", "address-level2", "name", "given-name", "family-name", "username", "email",
)
SEARCH_TERMS = r"(?i)(?:^|[^a-z0-9])(?:search|filter|find|query|institute|college|topic|keyword)(?:\z|[^a-z0-9])"
COMPACT_IDS = (
    (r"cardnumber|creditcardnumber|debitcardnumber|ccnumber|ccnum", "credit_card"),
    (r"accountnumber|bankaccountnumber|bankaccount", "bank_account"),
    (r"phonenumber|mobilenumber|contactnumber", "phone"),
    (r"dateofbirth|birthdate|dob", "date_of_birth"),
    (r"username|loginid|userid", "username"),
    (r"fullname|firstname|lastname|applicantname|candidatename|studentname|name|txtname|custname", "name"),
    (r"apikey|authkey|accesskey|accesstoken|secretkey", "token"),
    (r"ssn|aadhaar(?:number)?|aadhar(?:number)?|pannumber|socialsecuritynumber", "national_id"),
)
LABEL_PHRASES = (
    (r"password|passcode|passwd|pwd|current password|new password", "password"),
    (r"one time (?:code|password)|otp|2fa|mfa|verification code|auth(?:entication)? code", "auth_code"),
    (r"cvv|cvc|card security code|security code", "cvv"),
    (r"credit card|debit card|card number|card no|cc num|payment card", "credit_card"),
    (r"aadhaar|aadhar|ssn|social security(?: number)?|pan (?:number|no)|permanent account number|national id",
     "national_id"),
    (r"bank account|account number|account no|iban|ifsc|routing number", "bank_account"),
    (r"diagnosis|prescription|patient (?:notes?|record)|medical (?:notes?|history|record)"
     r"|health (?:diagnosis|record)|clinical (?:notes?|diagnosis)|doctor (?:notes?|diagnosis)", "uninspectable"),
    (r"date of birth|birth date|birthday|dob|bday", "date_of_birth"),
    (r"email|e mail|email address", "email"),
    (r"phone (?:number|no)|mobile (?:number|no)|telephone number|contact number|cellphone", "phone"),
    (r"street address|postal address|home address|permanent address|current address|pin code|pincode|postal code"
     r"|zipcode", "address"),
    (r"username|user name|user id|login id|login name|user handle", "username"),
    (r"(?:full|first|last|middle|applicant|candidate|student|user|your|person)\s*name"
     r"|(?:enter|type|input|provide)\s*(?:your\s*)?name", "name"),
    (r"api key|auth key|access token|secret key|secret canary|canary", "token"),
)
KEYWORDS = (
    "password", "passwd", "pwd", "passcode", "pin", "secret", "token", "api_key", "apikey", "auth_key", "cvv", "cvc",
    "security_code", "card_number", "cardnumber", "cc_num", "credit_card", "debit_card", "pan_number", "pan_no",
    "aadhaar", "aadhar", "ssn", "social_security", "bank_account", "account_number", "ifsc", "iban", "routing_number",
    "otp", "one_time_password", "2fa", "mfa", "medical", "diagnosis", "prescription", "patient", "patient_notes",
    "health", "doctor_note", "clinical", "phone", "mobile", "tel", "cell", "phonenumber", "phone_number",
    "mobile_number", "contact_number", "cellphone", "address", "street_address", "zipcode", "pincode", "pin_code",
    "postal_code", "currentaddress", "permanentaddress", "current_address", "permanent_address", "dob", "birth_date",
    "birthday", "bday", "dateofbirth", "date_of_birth", "username", "user_name", "login_id", "login_name", "user_id",
    "userid", "user_handle", "name", "full_name", "fullname", "first_name", "firstname", "last_name", "lastname",
    "applicant_name", "candidate_name",
)
# ---------------------------------------------------------------------------


def _label_patterns() -> list[tuple[str, str]]:
    out = []
    for phrases, category in LABEL_PHRASES:
        bounded = f"{BL}(?:{phrases}){BR}"
        if category == "name":
            # "name" alone counts at the start of the text, before a colon, or as the last word.
            bounded = rf"{bounded}|^name{BR}|{BL}name\s*:(?=[A-Za-z0-9_])|{BL}name\z"
        out.append((f"(?i){bounded}", category))
    return out


LABELS = _label_patterns()


def keyword_categories() -> list[tuple[str, str]]:
    """Keyword as words -> the first label class it belongs to; keywords of no class drop out."""
    out = []
    for keyword in KEYWORDS:
        words = keyword.replace("_", " ")
        category = next((c for p, c in LABELS if re.search(p.replace(r"\z", r"\Z"), words)), None)
        if category:
            out.append((words, category))
    return out


def _spaced(col: Column) -> Column:
    """camelCase, snake_case and kebab-case become words."""
    return F.regexp_replace(F.regexp_replace(
        F.coalesce(col, F.lit("")), r"([a-z0-9])([A-Z])", "$1 $2"), "[_-]+", " ")


def _first_category(pairs: list[tuple[Column, str]]) -> Column:
    out = F.lit(None).cast("string")
    for cond, category in reversed(pairs):
        out = F.when(cond, F.lit(category)).otherwise(out)
    return out


def _autocomplete(col: Column) -> tuple[Column, Column]:
    """The first known token, and the category of the token staged as ``_ac``."""
    known = F.get(F.filter(F.split(F.lower(F.coalesce(col, F.lit(""))), rf"{WS}+"),
                           lambda t: t.isin(*AUTOCOMPLETE_VALUES)), F.lit(0))
    category = (
        F.when(F.col("_ac") == "cc-csc", F.lit("cvv")).when(F.col("_ac").startswith("cc-"), F.lit("credit_card"))
        .when(F.col("_ac").startswith("bday"), F.lit("date_of_birth"))
        .when(F.col("_ac") == "one-time-code", F.lit("auth_code"))
        .when(F.col("_ac").startswith("tel"), F.lit("phone")).when(F.col("_ac") == "email", F.lit("email"))
        .when(F.col("_ac").contains("address") | (F.col("_ac") == "postal-code"), F.lit("address"))
        .when(F.col("_ac") == "username", F.lit("username")).when(F.col("_ac").contains("name"), F.lit("name"))
        .when(F.col("_ac").isNotNull(), F.lit("password")))
    return known, category


def classify_fields(fields: DataFrame) -> DataFrame:
    """Add ``sensitive, category, reason, confidence`` to editable fields.

    Columns used: ``tag, type, name, id, autocomplete, placeholder, aria_label, label_text, value``.
    Evidence in order: type, autocomplete, the live value, search wording (which clears the field),
    then per attribute the label phrases, compact identifiers and keywords.
    """
    def text(name):
        return F.coalesce(F.col(name), F.lit(""))

    kind, tag = F.lower(trim_ws(text("type"))), F.lower("tag")
    known, ac_category = _autocomplete(F.col("autocomplete"))
    staged = fields.withColumn("_ac", known).withColumn("_v", trim_ws(text("value"))).withColumn(
        "_value_hit", F.expr(f"get({all_spans('_v')}, 0).category"))
    attributes = ("name", "id", "placeholder", "label_text", "aria_label")
    for a in attributes:
        staged = staged.withColumn(f"_w_{a}", _spaced(F.col(a)))
    keywords = keyword_categories()
    found = []
    for a, shown in zip(attributes, ("name", "id", "placeholder", "label", "aria")):
        words = F.col(f"_w_{a}")
        pairs = [(words.rlike(p), c) for p, c in LABELS]
        if a in ("name", "id"):
            pairs += [(trim_ws(text(a)).rlike(rf"(?i)^(?:{p})\d*\z"), c) for p, c in COMPACT_IDS]
            pairs += [(words.rlike(rf"(?i)(?:^|[^a-z0-9])(?:{'|'.join(ws)})(?:\z|[^a-z0-9])"), c)
                      for ws, c in _runs(keywords)]
        staged = staged.withColumn(f"_c_{a}", _first_category(pairs))
        found.append(F.when(F.col(f"_c_{a}").isNotNull(), F.struct(
            F.col(f"_c_{a}").alias("category"), F.lit(f"sensitive {shown} field").alias("reason"))))
    searching = (kind == "search") | reduce(lambda x, y: x | y, [
        F.col(f"_w_{a}").rlike(SEARCH_TERMS) for a in ("name", "id", "placeholder", "aria_label")])

    def hit(category: Column, reason: Column) -> Column:
        return F.struct(category.alias("category"), reason.alias("reason"))

    verdict = F.when(~tag.isin("input", "textarea") | ((tag == "input") & kind.isin(*SAFE_INPUT_TYPES)), None)
    for value, category in TYPE_CATEGORY:
        verdict = verdict.when(kind == value, hit(F.lit(category), F.lit(f'input[type="{value}"]')))
    verdict = (
        verdict.when(F.col("_ac").isNotNull(), hit(ac_category, F.concat(F.lit('autocomplete="'), "_ac", F.lit('"'))))
        .when(F.col("_value_hit").isNotNull(), hit(F.col("_value_hit"), F.concat(
            F.lit("live value matches PII ("), "_value_hit", F.lit(")"))))
        .when(searching, None)
        .otherwise(F.coalesce(*found)))
    return staged.withColumn("_d", verdict).select(
        *fields.columns, F.col("_d").isNotNull().alias("sensitive"), F.col("_d.category").alias("category"),
        F.col("_d.reason").alias("reason"),
        F.when(F.col("_d").isNotNull(), F.lit(0.95)).otherwise(F.lit(1.0)).alias("confidence"))


def _runs(pairs: list[tuple[str, str]]) -> list[tuple[list[str], str]]:
    """Neighbours of one category share a pattern; their order against other categories stays."""
    runs: list[tuple[list[str], str]] = []
    for word, category in pairs:
        if runs and runs[-1][1] == category:
            runs[-1][0].append(word)
        else:
            runs.append(([word], category))
    return runs


def field_regions(classified: DataFrame, boxes: DataFrame, meta: DataFrame, keys=("capture_id", "local_id")) -> DataFrame:
    """Sensitive fields with their box on the screenshot; collapsed boxes drop out."""
    joined = classified.filter("sensitive").join(boxes, list(keys))
    return to_screenshot(joined, meta, pad=0).filter("sx_w > 1 AND sx_h > 1").withColumn(
        "source", F.lit("dom_semantic")).withColumn("method", F.lit("opaque_mask"))


# ---------------------------------------------------------------------------
# Canonical form slots and their names.
# slot -> (aliases, autocomplete values, input types)
# ---------------------------------------------------------------------------
SLOTS = {
    "password": (("password", "pass", "pwd", "secret", "passcode"), ("current-password", "new-password"),
                 ("password",)),
    "username": (("username", "user id", "userid", "account", "handle", "login id", "sign in", "signin id"),
                 ("username",), ()),
    "phone": (("contact", "contact no", "contact number", "phone", "phone no", "phone number", "telephone", "mobile",
               "mobile no", "mobile number", "usernumber", "user number", "mobile (10 digits)", "10 digits", "cell",
               "whatsapp", "tel", "phone field", "contact field"), ("tel", "tel-national", "tel-country-code"),
              ("tel",)),
    "email": (("email", "e-mail", "mail", "email id", "email address", "user email", "useremail", "email field"),
              ("email",), ("email",)),
    "fullName": (("full name", "your name", "name", "applicant name", "candidate name", "student name", "candidate",
                  "name field", "full name field"), ("name",), ()),
    "firstName": (("first name", "firstname", "given name", "fname", "first"), ("given-name",), ()),
    "lastName": (("last name", "lastname", "surname", "family name", "lname", "last"), ("family-name",), ()),
    "dateOfBirth": (("date of birth", "dob", "birth date", "birthday", "bday", "dateofbirth", "birth"),
                    ("bday", "bday-day", "bday-month", "bday-year"), ("date",)),
    "organization": (("organization", "organisation", "org", "company", "college", "college name", "company name",
                      "institute name", "university name", "school name", "organization name", "organisation name",
                      "org name", "institute", "institution", "university", "school", "employer"),
                     ("organization",), ()),
    "address": (("address", "street", "street address", "address line", "currentaddress", "current address",
                 "permanentaddress", "permanent address", "current-address", "permanent-address", "residence"),
                ("street-address", "address-line1", "address-line2"), ()),
    "city": (("city", "town", "district"), ("address-level2",), ()),
    "state": (("state", "province", "region"), ("address-level1",), ()),
    "postalCode": (("pin", "pincode", "pin code", "postal", "postal code", "zip", "zipcode", "zip code"),
                   ("postal-code",), ()),
    "country": (("country", "nation"), ("country", "country-name"), ()),
    "gender": (("gender", "sex", "male", "female", "gender-radio"), ("sex",), ()),
    "githubUrl": (("github", "github url", "git", "repo", "portfolio", "project url"), ("url",), ()),
}
PRIVACY_TOKENS = (
    ("email", r"(?i)\[EMAIL(?:\s+(?:ADDRESS|FIELD))?\]"),
    ("fullName", r"(?i)\[(?:(?:FULL\s+)?NAME|FULL\s+NAME\s+FIELD|NAME\s+FIELD)\]"),
    ("phone", r"(?i)\[PHONE(?:\s+(?:NUMBER|FIELD))?\]"),
    ("password", r"(?i)\[PASSWORD(?:\s+FIELD)?\]"),
    ("address", r"(?i)\[ADDRESS(?:\s+FIELD)?\]"),
)
# ---------------------------------------------------------------------------


def clean_tokens_col(col: Column) -> Column:
    """U16: camelCase split, lower case, punctuation to blanks."""
    out = F.lower(F.regexp_replace(F.coalesce(col, F.lit("")), r"([a-z0-9])([A-Z])", "$1 $2"))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[_\-:*()\[\]/\\]", " "), rf"{WS}+", " "))


def _clean_alias(alias: str) -> str:
    return " ".join(re.sub(r"[_\-:*()\[\]/\\]", " ", alias.lower()).split())


def semantic_type(fields: DataFrame, slots: dict | None = None) -> DataFrame:
    """Add ``slot, slot_confidence``; the best-scoring slot of at least 0.4, earlier slot on ties.

    Columns used: ``type, autocomplete, label_text, placeholder, aria_label, name, id, raw_name, sanitized_name``.
    """
    slots = slots or SLOTS
    have = set(fields.columns)

    def raw(name):
        return F.coalesce(F.col(name), F.lit("")) if name in have else F.lit("")

    staged = fields
    for n in ("label_text", "placeholder", "name", "id"):
        staged = staged.withColumn(f"_k_{n}", clean_tokens_col(raw(n)))
    corpus = F.array_join(F.filter(F.array(
        "_k_label_text", "_k_placeholder", clean_tokens_col(raw("aria_label")), "_k_name", "_k_id",
        clean_tokens_col(raw("raw_name")), clean_tokens_col(raw("sanitized_name"))), lambda x: x != ""), " ")
    staged = staged.withColumn("_corpus", corpus).withColumn("_padded", _padded(F.col("_corpus")))
    for n in ("label_text", "placeholder", "name", "id"):
        staged = staged.withColumn(f"_k_{n}", _padded(F.col(f"_k_{n}")))
    kind, auto = F.lower(trim_ws(raw("type"))), F.lower(trim_ws(raw("autocomplete")))
    scores = []
    for i, (slot, (aliases, autos, types)) in enumerate(slots.items()):
        score = F.lit(0.0)
        if types:
            score = score + F.when(kind.isin(*types), F.lit(0.45)).otherwise(F.lit(0.0))
        score = score + F.when(auto.rlike("|".join(autos)), F.lit(0.5)).otherwise(F.lit(0.0))
        ordered = sorted({_clean_alias(a): None for a in aliases}, key=lambda a: -len(a))
        staged = staged.withColumn(f"_a{i}", _winning_alias(slot, ordered))
        alias = F.col(f"_a{i}")

        def found_in(c, a=alias):
            return F.contains(c, F.concat(F.lit(" "), a, F.lit(" ")))

        base = (F.when(found_in(F.col("_k_label_text")), 0.60).when(found_in(F.col("_k_placeholder")), 0.55)
                .when(found_in(F.col("_k_name")) | found_in(F.col("_k_id")), 0.50).otherwise(0.40))
        score = score + F.coalesce(F.when(alias.isNotNull(), base + F.least(F.lit(0.15), F.length(alias) * 0.015)),
                                   F.lit(0.0))
        score = F.least(F.lit(1.0), score)
        if slot == "address":
            score = F.when(F.col("_corpus").rlike(rf"{BL}(?:email|e-mail|mail|web|url|ip|mac){BR}"), F.lit(0.0)).otherwise(score)
        scores.append(F.struct(score.alias("s"), F.lit(-i).alias("o"), F.lit(slot).alias("slot")))
    best = F.array_max(F.array(*scores))
    token = F.lit(None).cast("string")
    for slot, pattern in reversed(PRIVACY_TOKENS):
        token = F.when(raw("sanitized_name").rlike(pattern), F.lit(slot)).otherwise(token)
    # Settled, as a filter on the slot would be moved below and repeat every slot's words.
    staged = settled(staged, _best=best, _token=token)
    accepted = F.col("_best.s") >= 0.4
    return staged.select(
        *fields.columns,
        F.coalesce("_token", F.when(accepted, F.col("_best.slot"))).alias("slot"),
        F.when(F.col("_token").isNotNull(), F.lit(0.99)).when(
            accepted, F.floor(F.col("_best.s") * 100 + 0.5) / 100).alias("slot_confidence"))


def _padded(c: Column) -> Column:
    """Words between single blanks, so that a word sequence is a plain substring."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(c, "[^a-z0-9_]+", " ")), F.lit(" "))


def _winning_alias(slot: str, ordered: list[str]) -> Column:
    """Longest alias that stands as words in the corpus; a bare "name" is refused next to organisation words."""
    hits = F.filter(F.array(*[F.lit(a) for a in ordered]), lambda a: F.contains(
        F.col("_padded"), F.concat(F.lit(" "), a, F.lit(" "))))
    if slot == "fullName":
        org = F.col("_corpus").rlike(
            rf"{BL}(?:college|company|organization|organisation|university|institute|institution|school|employer|domain"
            rf"|host|file|folder){BR}")
        hits = F.when(org, F.array_remove(hits, "name")).otherwise(hits)
    return F.get(hits, F.lit(0))


# Placeholder shown instead of a sensitive field's name, and classes nobody may type into.
PLACEHOLDERS = {
    "password": "[PASSWORD FIELD]", "auth_code": "[OTP FIELD]", "credit_card": "[PAYMENT FIELD]", "cvv": "[PAYMENT FIELD]",
    "bank_account": "[PAYMENT FIELD]", "national_id": "[NATIONAL ID FIELD]", "email": "[EMAIL FIELD]",
    "phone": "[PHONE FIELD]", "token": "[TOKEN/KEY FIELD]",
}
OTHER_PLACEHOLDER = "[SENSITIVE FIELD]"
NOT_TYPABLE = ("password", "auth_code", "credit_card", "cvv", "bank_account", "token", "uninspectable", "high_risk_surface")


def sanitize_elements(elements: DataFrame, regions: DataFrame, keys=("capture_id", "local_id")) -> DataFrame:
    """Sensitive elements get a placeholder name, and lose ``type`` where typing is not allowed.

    ``elements(*keys, name, caps[])``; ``regions(*keys, category)`` has at most one row per element.
    Other names are scrubbed and cut; only those are scanned.
    """
    marks = regions.select(*keys, F.col("category").alias("_cat"))
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PLACEHOLDERS.items() for x in kv]), F.col("_cat")),
                       F.lit(OTHER_PLACEHOLDER))
    j = elements.join(marks, list(keys), "left").withColumn("_s", F.expr(f"CASE WHEN _cat IS NULL THEN {all_spans('name')} ELSE {NO_SPANS} END")).withColumn(
        "sanitized_name", F.when(F.col("_cat").isNotNull(), label).otherwise(short_name(cut_col("name", "_s"))))
    return j.withColumn("caps", F.when(F.col("_cat").isin(*NOT_TYPABLE), F.array_except("caps", F.array(F.lit("type")))).otherwise(
        F.col("caps"))).drop("_cat", "_s")
