"""Field sensitivity truth table and slots."""

from veil.functions import spans
from veil.operators import fields

COLS = ["tag", "type", "name", "id", "autocomplete", "placeholder", "aria_label", "label_text", "value"]
TABLE = [
    (dict(tag="input", type="password"), "password"), (dict(tag="input", type="email"), "email"), (dict(tag="input", type="tel"), "phone"),
    (dict(tag="input", autocomplete="section-checkout cc-number"), "credit_card"), (dict(tag="input", autocomplete="cc-csc"), "cvv"),
    (dict(tag="input", autocomplete="bday"), "date_of_birth"), (dict(tag="input", autocomplete="one-time-code"), "auth_code"),
    (dict(tag="input", autocomplete="current-password"), "password"), (dict(tag="input", name="cardNumber"), "credit_card"),
    (dict(tag="input", id="bankAccountNumber"), "bank_account"), (dict(tag="input", placeholder="Enter Aadhaar Number"), "national_id"),
    (dict(tag="textarea", name="patient_diagnosis"), "uninspectable"), (dict(tag="input", type="search", value="4532 0150 1234 5671"), "credit_card"),
    (dict(tag="input", type="search", value="4532 8901 2342"), "national_id"), (dict(tag="input", name="the_name_field"), "name"),
    (dict(tag="input", type="search", value="4532 8901 2345"), None),
    (dict(tag="input", type="search", name="username", placeholder="Search by Institute Name", value="IIT Delhi"), None),
    (dict(tag="input", type="text", name="college_filter", placeholder="Find college"), None), (dict(tag="input", type="text", name="city", value="Mumbai"), None),
    (dict(tag="a", aria_label="CONTACT US", name="phone_number"), None), (dict(tag="button", name="password"), None),
    (dict(tag="select", name="phone_number", value="Select State"), None), (dict(tag="input", type="submit", name="password"), None),
]


def test_truth_table(spark):
    rows = [(i, *[d.get(c) for c in COLS]) for i, (d, _) in enumerate(TABLE)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{c} string" for c in COLS))
    got = {r.i: r for r in fields.classify_fields(df).collect()}
    for i, (d, want) in enumerate(TABLE):
        assert got[i].category == want, d
        assert got[i].sensitive == (want is not None)


def test_slots(spark):
    rows = [(0, "E-mail address", None, "text"), (1, "College name", None, "text"), (2, "Name", None, "text"), (3, None, "given-name", "text"), (4, "Colour", None, "text")]
    df = spark.createDataFrame(rows, "i int, label_text string, autocomplete string, type string")
    got = {r.i: r.slot for r in fields.semantic_type(df).collect()}
    # "given-name" contains "name", so both name slots score 0.5 and the earlier one keeps it.
    assert got == {0: "email", 1: "organization", 2: "fullName", 3: "fullName", 4: None}


def test_a_filter_on_the_slot_repeats_no_words(spark):
    df = fields.semantic_type(spark.createDataFrame([("text", "Email address")], "type string, label_text string"))
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (df, df.filter("slot IS NOT NULL"))]
    assert plans[0].count("portfolio") == plans[1].count("portfolio") > 0
    assert [r.slot for r in df.filter("slot IS NOT NULL").collect()] == ["email"]


def test_only_names_that_are_shown_and_may_match_are_scanned(spark, monkeypatch):
    raised = f"cast(raise_error('scanned') as {spans.SPAN_TYPE})"
    monkeypatch.setattr(spans, "rule_spans", lambda text, rule: f"CASE WHEN {text} IS NULL THEN {spans.NO_SPANS} ELSE {raised} END")
    elements = spark.createDataFrame([(1, 1, "bob@a.example"), (1, 2, "v12"), (1, 3, None)], "capture_id int, local_id int, name string").selectExpr("*", "array('click', 'type') AS caps")
    regions = spark.createDataFrame([(1, 1, "token")], "capture_id int, local_id int, category string")
    rows = {r.local_id: (r.sanitized_name, r.caps) for r in fields.sanitize_elements(elements, regions).collect()}
    assert rows == {1: ("[TOKEN/KEY FIELD]", ["click"]), 2: ("v12", ["click", "type"]), 3: ("", ["click", "type"])}
