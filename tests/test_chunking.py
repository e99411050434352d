import time
from html.parser import HTMLParser

from pyspark.sql import functions as F

from shelfmark.functions.text import estimate_tokens
from shelfmark.operators import chunking as K


def test_greedy_groups(spark):
    df = spark.createDataFrame([([60, 60, 10, 200, 5, 5],), ([],)], "n array<int>")
    assert [r.g for r in df.select(K.greedy_groups(F.col("n"), 100).alias("g")).collect()] == [[0, 1, 1, 2, 3, 3], []]


def test_hierarchy(spark):
    leaves = spark.createDataFrame([("f", i, "公" * 45) for i in range(4)] + [("g", 0, "a"), ("g", 5, "b"), ("g", 9, "c")], "file_id string, chunk_index int, text string")
    kids, parents = K.build_hierarchy(leaves, 100)
    rows = {r.file_id: [] for r in parents.collect()}
    for r in parents.collect():
        rows[r.file_id].append(r)
    assert len(rows["f"]) == 4 and [(p.children_start, p.children_end, p.text) for p in rows["g"]] == [(0, 2, "a\n\nb\n\nc")]
    linked = {n for p in parents.collect() for n in p.children_node_ids}
    assert linked == {r.node_id for r in kids.collect()}
    assert sorted(r.chunk_index for r in kids.where("file_id = 'g'").collect()) == [0, 1, 2]


def test_tables_stay_whole(spark):
    docs = spark.createDataFrame([("f", "before [TABLE_START]a|b\n1|2[TABLE_END] after"), ("g", "[TABLE_START]t[TABLE_END]")], "file_id string, text string")
    rows = [(r.file_id, r.text, r.is_table) for r in K.split_structure(docs).orderBy("file_id", "seg").collect()]
    assert rows == [("f", "before ", False), ("f", "a|b\n1|2", True), ("f", " after", False), ("g", "t", True)]


def test_refined_pieces_keep_to_the_budget(spark):
    table = "a | b\n--- | ---\n" + "\n".join(f"row {i} | value {i}" for i in range(200))
    chunks = spark.createDataFrame([("t", table), ("l", "word " * 3000), ("s", "short"), ("c", "公" * 900)], "node_id string, text string")
    out = K.refine_oversized(chunks, 100).withColumn("n", estimate_tokens(F.col("text"))).collect()
    assert all(r.n <= 130 for r in out)
    parts = sorted((r for r in out if r.node_id == "t"), key=lambda r: r.part)
    assert len(parts) > 1 and all(r.text.startswith("a | b\n--- | ---\n") for r in parts)
    assert sum(r.text.count("row ") for r in parts) == 200
    assert "".join(r.text for r in sorted((r for r in out if r.node_id == "c"), key=lambda r: r.part)).replace("\n", "") == "公" * 900
    assert [r.text for r in out if r.node_id == "s"] == ["short"]


def test_small_chunks_merge(spark):
    rows = [("f", i, t, i) for i, t in enumerate(["aaa", "bbb", "c" * 400, "d"])]
    out = K.merge_small(spark.createDataFrame(rows, "file_id string, chunk_index int, text string, page_no int"), 20, F.length("text")).orderBy("chunk_index").collect()
    assert [(r.text[:7], r.page_no) for r in out] == [("aaa\nbbb", 0), ("ccccccc", 2), ("d", 3)]


def test_drop_counters(spark):
    from pyspark.sql import Observation

    seen = Observation()
    chunks = spark.createDataFrame([("f", 0, "a"), ("f", 1, " a "), ("f", 2, "---"), ("f", 3, "b")], "file_id string, chunk_index int, text string")
    assert {r.chunk_index for r in K.clean_leaves(chunks, seen).collect()} == {0, 3}
    assert seen.get == {"seen": 4, "low_value": 1}


def test_overlap_carries_the_last_sentence(spark):
    docs = spark.createDataFrame([("f", "One two three. Four five six. Seven eight nine.")], "file_id string, text string")
    out = [r.text for r in K.pack_sentences(docs, 5, overlap=10).orderBy("chunk_index").collect()]
    assert out == ["One two three.", "One two three. Four five six.", "Four five six. Seven eight nine."]


def test_html_blocks(spark):
    pages = spark.createDataFrame([(1, "<html><head><title>t</title></head><body><script>x</script><h1>Top</h1><p>One &amp; two<br>three<h2>Sub</h2><ul><li>a<li>b</ul></body></html>")], "page_id long, html string")
    rows = [(r.block_index, r.text, r.heading) for r in K.html_blocks(pages).orderBy("block_index").collect()]
    assert rows == [(0, "Top", "Top"), (1, "One & two", "Top"), (2, "three", "Top"), (3, "Sub", "Sub"), (4, "a", "Sub"), (5, "b", "Sub")]


def test_cells_of_triplets(spark):
    chunks = spark.createDataFrame([(1, "Caption\n\nNorth, sales = 12.5. South, sales = 3.")], "node_id int, text string")
    assert {(r.row, r.col, r.value) for r in K.table_cells(chunks).collect()} >= {("South", "sales", "3")}


def test_marks_without_partner_are_text(spark):
    docs = spark.createDataFrame([("f", "Plain [TABLE_END] tail [TABLE_START] t|u\n[TABLE_END]z"), ("g", "T [TABLE_START]open"), ("h", "Table"), ("i", "[TABLE_START][TABLE_END]x\x02y")], "file_id string, text string")
    rows = [(r.file_id, r.text, r.is_table) for r in K.split_structure(docs).orderBy("file_id", "seg").collect()]
    assert rows == [("f", "Plain [TABLE_END] tail ", False), ("f", "t|u", True), ("f", "z", False), ("g", "T [TABLE_START]open", False), ("h", "Table", False), ("i", "xy", False)]


class _Visible(HTMLParser):
    """Blocks and heading paths by a parser of its own kind."""

    BREAKS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol table tr td th article section nav footer header br body html main aside".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.text, self.skip, self.level, self.path = [], "", 0, 0, {}

    def end(self):
        text = " ".join(self.text.split())
        if text:
            if self.level:
                self.path = {k: v for k, v in self.path.items() if k < self.level} | {self.level: text}
            self.blocks.append((text, [self.path[k] for k in sorted(self.path)]))
        self.text, self.level = "", 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "head")
        if tag in self.BREAKS:
            self.end()
            self.level = int(tag[1]) if tag[0] == "h" and tag[1:].isdigit() else 0

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "head")
        if tag in self.BREAKS:
            self.end()

    def handle_data(self, data):
        self.text += "" if self.skip else data


def test_html_blocks_match_another_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {}
    for r in K.html_blocks(pages).orderBy("page_id", "block_index").collect():
        found.setdefault(r.page_id, []).append((r.text, r.headings))
    for r in pages.collect():
        parser = _Visible()
        parser.feed(r.html)
        parser.close()
        parser.end()
        assert found.get(r.page_id, []) == parser.blocks, r.page_id
    odd = spark.createDataFrame([(1, "<p>Hello world</p><h2>Help</h2><p>H&eacute; &#72;i</p><h1>Top</h1><h3>Low</h3>x<h2>Mid</h2>y")], "page_id long, html string")
    rows = [(r.text, r.heading, r.headings) for r in K.html_blocks(odd).orderBy("block_index").collect()]
    assert rows == [("Hello world", None, []), ("Help", "Help", ["Help"]), ("Hé Hi", "Help", ["Help"]), ("Top", "Top", ["Top"]), ("Low", "Low", ["Top", "Low"]), ("x", "Low", ["Top", "Low"]), ("Mid", "Mid", ["Top", "Mid"]), ("y", "Mid", ["Top", "Mid"])]


def test_cells_as_a_table_function(spark):
    K.register_table_cells(spark)
    text = "| h | c1 | c2 |\\n| --- | --- | --- |\\n| r | 1.5 | x |"
    rows = {tuple(r) for r in spark.sql(f"SELECT * FROM table_cells('{text}')").collect()}
    chunks = spark.createDataFrame([(1, text.replace("\\n", "\n"))], "node_id int, text string")
    assert rows == {(r.row, r.col, r.value) for r in K.table_cells(chunks).collect()} == {("r", "c1", "1.5"), ("r", "c2", "x")}


def test_structured_chunks(spark):
    table = "a | b\n--- | ---\n" + "\n".join(f"row {i} | value {i}" for i in range(60))
    docs = spark.createDataFrame([("f", f"Before it. [TABLE_START]{table}[TABLE_END] " + "After it there is more. " * 80), ("g", "tiny\x00. text.")], "file_id string, text string")
    out = K.structured_chunks(docs, 100).collect()
    assert all(estimate_of(r.text) <= 135 for r in out) and sum(r.text.count("row ") for r in out) == 60
    assert [r.text for r in out if r.file_id == "g"] == ["tiny. text."]
    assert sum(r.text.count("a | b\n--- | ---\n") for r in out) > 1


def estimate_of(text):
    return int(0.3 * len(text))


def test_marks_inside_values_and_open_elements(spark):
    blocks = lambda html: [t for t, _ in K.visible_blocks(html)]
    assert blocks('<p title="a>b">c') == ["c"] and blocks("<p title='a>\"b' x=1>c</p>") == ["c"]
    assert blocks("<p>a</p><script>var leaks = 1 < 2;") == ["a"] and blocks("<script>x</SCRIPT >y") == ["y"]
    assert blocks("a<!-- b --><!-- c") == ["a"] and blocks("1 < 2 &lt;b&gt; a<b") == ["1 < 2 <b> a"]
    assert blocks("x &am<b>p;</b> y") == ["x &amp; y"] and blocks("<head><title>t</title><body>b") == ["b"]
    assert blocks("<style>a{}</style>b<!doctype html>c<?x?>d</3>e") == ["bcde"]
    assert blocks("") == blocks("<p></p>  ") == blocks("<p") == []


def test_blocks_take_time_by_length():
    for html in ("<!--" * 250_000, '<p title="' * 100_000, "<p a=" * 200_000, "<script>" * 100_000, "<" * 1_000_000, "&am" * 300_000, "<p a='x\"" * 100_000, "</" * 500_000, "<p>" * 300_000):
        began = time.perf_counter()
        K.visible_blocks(html)
        assert time.perf_counter() - began < 5, html[:20]


def test_pieces_are_put_together_where_they_lie(spark):
    """Packing where a text lies gives what packing of rows gives; cutting sends nothing, and merging deals rows out once."""
    texts = [None, "", "  ", "one", "One. Two! Three?\nfour " + "x" * 40 + ". " + "y " * 30, *[". ".join(f"s{i} {'w' * (i * k % 23)}" for k in range(i)) for i in range(2, 30)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "file_id int, text string")
    rows, lying = (sorted(map(tuple, K.pack_sentences(docs, 6, different=d).collect())) for d in (False, True))
    assert rows == lying and len(rows) > 60
    chunks = docs.select("file_id", F.col("file_id").alias("chunk_index"), F.lit(1).alias("page_no"), "text")
    for plan, sent in ((K.pack_sentences(docs, 6, different=True), 0), (K.refine_oversized(docs.select(F.col("file_id").alias("node_id"), "text"), 40), 0), (K.merge_small(chunks, 40), 1)):
        assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == sent


def test_a_corpus_is_cut_where_it_lies(spark):
    """Without sending a text; leaves and parents are those of the steps one after another, also where a file_id is repeated or missing."""
    texts = [None, "", " ", "```", "a.\x01 b.\n a.\n\x02a.\na. \n---\n | ", "会议记录。下一句! x\n" * 9, "é ü ñ. " * 40, "\x07\n\u200b\n\u3000", "One. Two! Three?\nfour " + "x" * 300 + ". " + "y " * 30]
    texts += [". ".join(f"s{i} {'w' * (i * k % 23)}" for k in range(i)) for i in range(2, 40)] + ["same line here.\n" * 50 + "another one.\n" * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "file_id long, text string")
    rows = lambda df: sorted((str(sorted(r.asDict().items())) for r in df.collect()))
    for odd, table in ((False, docs), (True, docs.unionByName(docs.where("file_id > 40"))), (True, docs.unionByName(spark.createDataFrame([(None, "no file. none.")], docs.schema)))):
        found = K.chunk_corpus(table, 8, 40)
        expected = K.build_hierarchy(K.clean_leaves(K.pack_sentences(table, 8)), 40)
        assert rows(found[0]) == rows(expected[0]) and rows(found[1].select(expected[1].columns)) == rows(expected[1]) and found[0].count() > 100
        assert odd or not any("Exchange" in df._jdf.queryExecution().executedPlan().toString() for df in found)
