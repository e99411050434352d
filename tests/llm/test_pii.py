import hashlib
import re

from shelfmark.llm import pii

# the contract's own patterns
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text) if passes(k, m.group())] for k, p in BASE.items()}


TEXTS = {
    1: None, 2: "", 3: "a@b.c%d@e.f 4111 1111 1111 1111 and 1.2.3.4.5.6.7.8 é +1 (017) 555-7713 x", 4: "999.1.1.1 0255.1.1.1 joe(at)x.com 1[.]2[.]3[.]4 éé 😀 4111-1111-1111-1111",
    5: "1" * 30_000 + " " + "a" * 20_000 + " +1" * 3000, 6: "mail me: x.y@mail.example.com, y@z.org; ips 10.0.0.1 10.0.0.256", 7: "+123456789 +12 3 +1234567890123456 " * 30, 8: "no data here",
}


def test_base_rules_match_brute_force_and_stay(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in TEXTS.items()] + [(None, "a@b.c", "x"), (6, TEXTS[6], "x")], "doc_id long, text string, spans string")
    rows = pii.personal_data(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        found = brute((TEXTS[r.doc_id] if r.doc_id else "a@b.c") or "")
        spans = ",".join(f"{k}:{a}:{b}" for k in BASE for a, b in found[k])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(found[k]) for k in BASE), r.doc_id
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert set(spans.split(",")) <= set(r.spans.split(","))
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_trees_add_looser_forms(spark):
    rows = [(i, f"write to user{i}@mail{i % 9}.example.com or {i % 200}.{i % 90}.7.{i % 250} version {i % 10}.{i % 7} or {i}12.{i} and +1 (2{i % 90:02d}) 555-{1000 + i % 9000} build {300 + i}.{400 + i}.5.{600 + i % 300}", "x") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    model = pii.fit(docs)
    assert model.trees
    ask = spark.createDataFrame([(1, "reach joe(at)mail3.example.com or 10[.]20[.]30[.]40 now", "x"), (2, "section 3.1 of 2024 and 12 apples", "x")], docs.schema)
    found = {r.doc_id: r.spans for r in pii.personal_data(ask, model).collect()}
    assert found[1].startswith("email:6:30") and found[2] == ""
    texts = {r.doc_id: r.text for r in pii.redact(ask, model).collect()}
    assert "[EMAIL]" in texts[1] and texts[2] == "section 3.1 of 2024 and 12 apples"


def test_redaction_keeps_everything_else(spark):
    docs = spark.createDataFrame([(1, "é a@b.co, 1.2.3.4 é", 19, "k"), (2, None, 0, "k"), (None, "x", 1, "k")], "doc_id long, text string, n_chars long, base_email string")
    out = pii.redact(docs)
    assert out.columns == docs.columns and {r.base_email for r in out.collect()} == {"k"}
    rows = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert rows == {1: ("é [EMAIL], [IP] é", 17), 2: (None, 0), None: ("x", 1)}


def test_runs_without_python(spark):
    docs = spark.createDataFrame([(1, "a@b.co")], "doc_id long, text string")
    plan = pii.personal_data(docs, pii.Model([], {k: 1.1 for k in pii.KINDS}))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_looser_forms_in_the_corpus_are_not_learnt_as_false(spark):
    """A third of the documents spell their data loosely; the model adds those and leaves look-alikes."""
    def row(i):
        user, card = f"user{i}", f"4111 1111 1111 {1111 if i % 2 else 1112}"
        if i % 3 == 0:
            return f"ask {user}(at)mail{i % 9}.example.com or 10[.]20[.]{i % 200}[.]4 and call 00.555.{i % 900 + 100}.4321 card 4111.1111.1111.1111 end"
        return f"ask {user}@mail{i % 9}.example.com or 10.20.{i % 200}.4 and call +1 555 {i % 900 + 100} 4321 card {card} on 2024-05-{i % 28 + 1:02d} at 10.30 end"

    docs = spark.createDataFrame([(i, row(i), "x") for i in range(600)], "doc_id long, text string, source string")
    model = pii.fit(docs)
    assert all(0.5 <= t <= 1 for t in model.thresholds.values()), model.thresholds
    found = pii.find(docs, model)
    added = {k: sum(len(r[0]) for r in found.where("doc_id % 3 = 0").select(f"all_{k}").collect()) for k in pii.KINDS}
    assert all(added[k] >= 190 for k in pii.KINDS), added
    for r in found.where("doc_id % 3 != 0").collect():
        assert [len(r[f"all_{k}"]) for k in pii.KINDS] == [len(r[f"base_{k}"]) for k in pii.KINDS], r
    alike = spark.createDataFrame([(1, "version 2.14 of 2024-05-17, pages 12-15, 300.400.5.6, 1234 5678 9012 3456, sum 12.50 at home.", "x")], docs.schema)
    assert pii.personal_data(alike, model).first().spans == ""


def test_many_matches_in_one_text(spark):
    text = "a@b.co " * 3000
    row = pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string"), pii.Model([], {k: 1.1 for k in pii.KINDS})).first()
    assert row.n_email == 3000 and row.spans.split(",")[2999] == f"email:{2999 * 7}:{2999 * 7 + 6}"


class Every(pii.Model):
    """Chooses all candidates."""

    def __init__(self):
        super().__init__([], {k: 0.0 for k in pii.KINDS})


def brute_all(text):
    """All spans if every loose candidate is chosen: base ones, then candidates beside them, earlier kinds first."""
    base = brute(text)
    taken = [x for k in BASE for x in base[k]]
    meets = lambda s, others: any(o[0] < s[1] and s[0] < o[1] for o in others)
    new = {k: [(m.start(), m.end()) for m in re.finditer(pii.LOOSE[k], text) if not meets(m.span(), taken)] for k in BASE}
    kinds = list(BASE)
    return {k: sorted(base[k] + [s for s in new[k] if not any(meets(s, new[o]) for o in kinds[:i])]) for i, k in enumerate(kinds)}


def brute_redacted(text):
    at, out = 0, []
    for a, b, k in sorted((a, b, k.upper()) for k, spans in brute_all(text).items() for a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{k}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_added_spans_and_redaction_match_brute_force(spark):
    import random

    random.seed(4)
    pieces = ["a@b.co ", "joe(at)x.com ", "1.2.3.4", "10[.]20[.]30[.]40 ", "4111 1111 1111 1111 ", "4111.1111.1111.1112", "+1 555 123 4567 ", "00.555.123.4321 ", "😀", "é ", "word ", "\n", "999.1.2.3 ", "12/13/14 15 16 17 18 19 20 "]
    texts = ["".join(random.choices(pieces, k=n)) for n in (1, 3, 10, 40, 300, 1500) for _ in range(4)] + ["", "x" * 4096 + "a@b.co" + "y" * 8192, "é" * 4095 + "joe(at)x.com"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.personal_data(docs, Every()).collect():
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, spans in brute_all(texts[r.doc_id]).items() for a, b in spans), r.doc_id
    for r in pii.redact(docs, Every()).collect():
        assert r.text == brute_redacted(texts[r.doc_id]), r.doc_id


def test_twenty_thousand_matches_in_one_text(spark):
    import time

    text = "a@b.co joe(at)x.com " * 10_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.monotonic()
    row = pii.personal_data(docs, Every()).first()
    assert row.n_email == 10_000 and row.spans.count("email") == 20_000
    assert pii.redact(docs, Every()).first().text == "[EMAIL] [EMAIL] " * 10_000
    # planning takes most of it (some 20 s each), comparing all with all took minutes
    assert time.monotonic() - began < 240


def test_all_labelled_candidates_are_learnt_from(spark):
    """Beyond 20,000, a sample by hash was."""
    docs = spark.createDataFrame([(i, " and ".join(f"user{20 * i + j}@mail.example.com" for j in range(20))) for i in range(300)], "doc_id long, text string")
    rows = pii._labelled_counts(docs.union(docs)).groupBy("label").sum("n").collect()
    # each address as it stands, in four looser spellings, and spoilt
    assert {r.label: r[1] for r in rows} == {1.0: 5 * 6000, 0.0: 6000}
