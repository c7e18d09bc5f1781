import base64

from pyspark.sql import functions as F

from keyhound.operators import compose, decode, scan, validate
from keyhound.plans import rules

TOKEN = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
ONE = "[[rules]]\nid='t'\nregex='''key = \"(\\w+)\"'''\nkeywords=['key']\n"


def frags(spark, *texts, path="a.txt", start=0):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "fragment_id long, raw string")
    return df.withColumn("start_line", F.lit(start)).withColumn("attributes", F.create_map(F.lit("path"), F.lit(path)))


def place(f):
    return [(r.start_line, r.end_line, r.start_column, r.end_column, r.line) for r in f.orderBy("fragment_id", "start_line", "start_column").collect()]


def test_locations(spark):
    f = scan.findings(frags(spark, 'key = "ab" é', 'é\n\tkey = "ab" x\nz', 'x\nkey = "ab"', 'key = "a" key = "a"'), rules.parse(ONE))
    assert place(f) == [
        (0, 0, 1, 10, 'key = "ab" é'),
        (1, 1, 3, 12, '\n\tkey = "ab" x'),
        (1, 1, 2, 11, 'x\nkey = "ab"'),
        (0, 0, 1, 9, 'key = "a" key = "a"'),
        (0, 0, 11, 19, 'key = "a" key = "a"'),
    ]


def test_allow_comments_secret_groups_and_fingerprints(spark):
    f = scan.findings(frags(spark, 'key = "ab" # keyhound:allow\nkey = "cd"\n', 'KEY = "zz"'), rules.parse(ONE))
    r = f.collect()
    assert [(x.secret, x.fingerprint) for x in r] == [("cd", "a.txt:t:1")]


def test_keywords_gate_rules_and_fold_case(spark):
    c = rules.parse("[[rules]]\nid='a'\nregex='(?i)key'\nkeywords=['KEY']\n[[rules]]\nid='b'\nregex='x'")
    got = {(r.fragment_id, r.rule_id) for r in scan.keyword_candidates(frags(spark, "a \u212aey", "none"), c).collect()}
    assert got == {(0, "a"), (0, "b"), (1, "b")}


def test_filters_keep_on_null_and_skip_on_true(spark):
    c = rules.parse("filter = 'get(attributes, \"path\", \"\") == \"a.txt\" && finding[\"secret\"] == \"ab\"'\n" + ONE)
    assert [r.secret for r in scan.findings(frags(spark, 'key = "ab"', 'key = "cd"'), c).collect()] == ["cd"]
    c = rules.parse("prefilter = 'matchesAny(attributes[\"path\"], [\"txt$\"])'\n" + ONE)
    assert scan.findings(frags(spark, 'key = "ab"'), c).count() == 0


def test_composites_need_all_parts_near(spark):
    c = rules.parse(ONE + "[[rules.required]]\nid='u'\nwithinLines=1\n[[rules]]\nid='u'\nregex='user=(\\w+)'\nskipReport=true")
    f = compose.composed(scan.findings(frags(spark, 'user=bob\nkey = "ab"', 'user=bob\n\n\nkey = "ab"', 'user=a user=b\nkey = "ab"'), c), c)
    got = {r.fragment_id: sorted(s.components[0].secret for s in r.required_sets) for r in f.collect()}
    assert got == {0: ["bob"], 2: ["a", "b"]}


def test_components_are_redacted_too(spark):
    c = rules.parse(ONE + "[[rules.required]]\nid='u'\n[[rules]]\nid='u'\nregex='user=(?P<n>\\w+)'\nskipReport=true")
    r = compose.scan(frags(spark, 'user=bob key = "ab"'), c, redact=100, context="0C").first()
    part = r.required_sets[0].components[0]
    assert (r.secret, r.match_context) == ("REDACTED", 'key = "REDACTED"')
    assert (part.secret, part.match, part.capture_groups[0].value) == ("REDACTED", "user=REDACTED", "REDACTED")


def test_required_sets_are_capped(spark):
    c = rules.parse(ONE + "[[rules.required]]\nid='u'\n[[rules]]\nid='u'\nregex='u(\\d+)'\nskipReport=true")
    f = compose.composed(scan.findings(frags(spark, " ".join(f"u{i}" for i in range(150)) + ' key = "ab"'), c), c)
    assert len(f.first().required_sets) == compose.MAX_SETS


def test_specificity_ignore_baseline_redaction(spark):
    c = rules.parse(ONE + "[[rules]]\nid='g'\nregex='\\w{2,}'\nspecificity=0")
    f = scan.findings(frags(spark, 'key = "secret1"'), c)
    left = compose.suppressed(f)
    assert {(r.rule_id, r.secret) for r in left.collect()} == {("t", "secret1"), ("g", "key")}
    ignored = compose.ignore_rows(spark.createDataFrame([("# c",), ("a.txt:g:0",)], "value string"))
    assert {r.rule_id for r in compose.without_ignored(left, ignored).collect()} == {"t"}
    assert compose.without_baseline(left, left).count() == 0
    r = compose.redacted(left.where("rule_id = 't'"), 50).first()
    assert (r.secret, r.match) == ("secr...", 'key = "secr..."')
    assert compose.redacted(left.where("rule_id = 't'")).first().secret == "REDACTED"


def test_decoding_is_located_in_the_original(spark):
    inner = base64.b64encode(f'key = "{TOKEN}"'.encode()).decode()
    outer = base64.b64encode(f"x {inner} y".encode()).decode()
    f = decode.decoded_findings(frags(spark, f"a\n{inner} b", f"{outer}"), rules.parse(ONE), 3)
    got = {(r.fragment_id, r["pass"]): (r.secret, r.start_line, r.start_column, r.end_column, r.tags) for r in f.collect()}
    assert got[0, 1] == (TOKEN, 1, 2, 1 + len(inner), ["decoded:base64", "decode-depth:1"])
    assert got[1, 2] == (TOKEN, 0, 1, len(outer), ["decoded:base64", "decode-depth:2"])


def test_texts_without_encodings_do_not_change():
    for t in ("", "plain words, nothing more", "0123", "%zz %4", "\\u00", "U+12", "QUJD"):
        assert decode.decode_all(t, 3) == []
    assert decode.decode_all("%41%42", 2)[0][1] == "AB"
    assert decode.decode_all(r"\u0041\\u0042", 1)[0][1] == "AB"
    assert decode.decode_all("U+0041 U+0042 x", 1)[0][1] == "AB x"
    assert decode.decode_all("%00%41", 1) == []


def test_validation_rolls_up_by_rank(spark):
    rows = spark.createDataFrame([(1, "invalid", "a", 0), (1, "valid", "b", 2), (1, "valid", "c", 1), (2, "", "", 0)], "g int, validation_status string, validation_reason string, p int")
    got = {r.g: (r.validation_status, r.validation_reason) for r in validate.rollup(rows, ["g"], "p").collect()}
    assert got == {1: ("valid", "c"), 2: ("", "")}


def test_context_specs():
    assert scan.context_spec("10L") == ("box", 0, 0, 9, 9)
    assert scan.context_spec("-2C,+4C") == ("cols", 2, 4, 0, 0)
    assert scan.context_spec("") == ("none", 0, 0, 0, 0)


def test_sets_are_validated_each(spark):
    c = rules.parse(ONE + "[[rules.required]]\nid='u'\n[[rules]]\nid='u'\nregex='user=(?P<name>\\w+)'\nskipReport=true")
    f = compose.composed(scan.findings(frags(spark, 'user=ann user=bob user=cy\nkey = "ab"', 'user=zoe user=dan\nkey = "ab"', 'user=zoe\nkey = "ab"'), c), c)

    def evaluate(keys):
        name = F.element_at("captures", "u:name")
        result = F.when(name.isin("ann", "cy"), F.lit("Valid")).when(name == "bob", F.lit("invalid")).otherwise(F.lit("odd"))
        return keys.where(name != "zoe").select("key", result.alias("result"), name.alias("reason"), F.create_map(F.lit("empty"), F.lit(""), F.lit("u"), F.element_at("captures", "u")).alias("metadata"))

    got = {r.fragment_id: (r.validation_status, r.validation_reason, r.validation_meta, [(s.components[0].secret, s.validation_status) for s in r.required_sets]) for r in validate.validated_sets(f, None, evaluate).collect()}
    assert got == {
        0: ("valid", "ann", {"u": "ann"}, [("ann", "valid"), ("cy", "valid")]),
        1: ("unknown", "dan", {"u": "dan"}, [("zoe", ""), ("dan", "unknown")]),
        2: ("", "", None, [("zoe", "")]),
    }
    plain = rules.parse(ONE)
    f = compose.composed(scan.findings(frags(spark, 'key = "ab"'), plain), plain)
    answer = lambda k: k.select("key", F.lit("valid").alias("result"), F.lit(None).cast("string").alias("reason"), F.create_map(F.lit("e"), F.lit("")).alias("metadata"))
    assert validate.validated_sets(f, None, answer, keep_empty=True).first().validation_meta == {"e": ""}
    assert validate.validated_sets(f.limit(0), None, answer).count() == 0


def test_a_line_of_thousands_of_findings(spark):
    """Composites and suppression on one long line: components are limited before the join, secrets compared once."""
    c = rules.parse("[[rules]]\nid='p'\nregex='p(\\d+)'\n[[rules.required]]\nid='u'\nwithinLines=1\n[[rules]]\nid='u'\nregex='u(\\d+)'\nskipReport=true\n[[rules]]\nid='g'\nregex='[0-9]{3}'\nspecificity=0")
    line = " ".join(f"p{i:05} u{i:05}" for i in range(5000))
    found = compose.materialised(scan.findings(frags(spark, line), c))
    assert found.count() > 15_000
    pairs = compose.required_pairs(found, c)
    assert pairs.count() == 5000 * compose.MAX_SETS
    out = compose.composed(found, c).where("rule_id = 'p'")
    assert out.count() == 5000 and out.agg(F.min(F.size("required_sets")), F.max(F.size("required_sets"))).first() == (100, 100)
    assert compose.suppressed(found.where("rule_id <> 'u'")).where("rule_id = 'g'").count() == 0


def test_components_by_columns_equal_all_pairs(spark):
    c = rules.parse("[[rules]]\nid='p'\nregex='p'\n[[rules.required]]\nid='u'\nwithinLines=1\nwithinColumns=7\n[[rules]]\nid='u'\nregex='u'\nskipReport=true")
    text = "p..u....p...........u.p\n.u..........p......u\n\n....u"
    found = scan.findings(frags(spark, text), c)
    at = {k: [(r.start_line, r.start_column) for r in found.where(f"rule_id = '{k}'").collect()] for k in "pu"}
    want = sorted((x, y) for x in at["p"] for y in at["u"] if abs(x[0] - y[0]) <= 1 and abs(x[1] - y[1]) <= 7)
    got = compose.required_pairs(found, c).select("start_line", "start_column", "component.start_line", "component.start_column").collect()
    assert sorted(((a, b), (x, y)) for a, b, x, y in got) == want


def test_filters_share_shapes_and_see_context(spark):
    many = "\n".join(f"[[rules]]\nid='r{i}'\nregex='(k{i}x\\w+)'\nkeywords=['k{i}x']\nfilter='entropy(finding[\"secret\"]) <= {i / 10}'" for i in range(30))
    config = rules.parse(many)
    assert len(scan._shapes(list(config.rules.values()))[0]) == 1
    got = {r.rule_id for r in scan.findings(frags(spark, " ".join(f"k{i}xabcdefgh" for i in range(30))), config).collect()}
    assert got == {r for r in config.rules if int(r[1:]) / 10 < 3.2}
    c = rules.parse("[[rules]]\nid='a'\nregex='key'\nfilter='finding[\"context\"] contains \"near\"'")
    far = "\n" * 21
    assert [r.fragment_id for r in scan.findings(frags(spark, f"near{far}key", f"near{far[1:]}key", "x" * 400 + "key" + "y" * 347 + "near", "x" * 400 + "key" + "y" * 346 + "near"), c).collect()] == [0, 2]
    for bad in ('finding["secert"] == "x"', "finding.nothing == 1"):
        try:
            scan.findings(frags(spark, "x"), rules.parse(f"[[rules]]\nid='a'\nregex='x'\nfilter='''{bad}'''")).count()
            raise AssertionError(bad)
        except ValueError:
            pass


def test_box_contexts_clip_columns(spark):
    c = rules.parse("[[rules]]\nid='a'\nregex='key'")
    f = scan.findings(frags(spark, "0123456789\nab\n....key....\nlong line here"), c, context="2L,-2C,+3C")
    assert f.first().match_context == "ab\n..key...\nng line "


def test_fragments_take_one_path_and_null_attributes(spark):
    d = spark.createDataFrame([(1, "x", {"path": "old", "a": "b"}), (2, None, None)], "i long, t string, m map<string,string>")
    got = {r.fragment_id: (r.raw, r.attributes) for r in scan.fragments(d, "t", "i", F.lit("new"), attributes=F.col("m")).collect()}
    assert got == {1: ("x", {"path": "new", "a": "b"}), 2: ("", {"path": "new"})}


def test_rules_of_services_have_names_of_their_own():
    from keyhound.plans import services

    made = services.service_rules()
    assert len({r.id for r in made}) == len(made) >= 412 and len(set(services.SERVICES)) == len(services.SERVICES)
