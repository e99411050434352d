"""Documents to leaf chunks and their parents, as DataFrame operations; greedy groups are made from arrays of small numbers, an Arrow batch at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.text import CONTROL, clean_text, contextualize, estimate_tokens, is_low_value
from shelfmark.sources.durable import Scratch

START, STOP = "[TABLE_START]", "[TABLE_END]"
LEAF_TOKENS, PARENT_TOKENS = 256, 2048


def leaf_budget(leaf_tokens: int, contextual: bool) -> int:
    """Leaves with a context prefix have less room for their own text."""
    return min(leaf_tokens, 380 if contextual else 450)


def _places(sizes: list[int], budget: float, below: float) -> list[int]:
    """Group numbers: an element joins the group before if their sum fits in the room and both are below `below`. In time proportional to the elements."""
    groups, group, total = [], -1, 0
    for n in sizes:
        if group >= 0 and total + n <= budget and total < below and n < below:
            total += n
        else:
            group, total = group + 1, n
        groups.append(group)
    return groups


def _each(sizes: pd.Series, room: pd.Series, least: pd.Series) -> Iterator[list[int]]:
    for each, budget, below in zip(sizes, room.tolist(), least.tolist(), strict=True):
        yield [] if each is None else _places(each.tolist(), budget, below)  # Python's own numbers are several times faster than numpy's here


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _greedy(sizes: pd.Series, room: pd.Series, least: pd.Series) -> pd.Series:
    return pd.Series(list(_each(sizes, room, least)), dtype=object)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _edges(sizes: pd.Series, room: pd.Series, least: pd.Series) -> pd.Series:
    """The place of each group's first element, from 1 on, and one more for the end."""
    return pd.Series([[i + 1 for i, g in enumerate(groups) if i == 0 or groups[i - 1] != g] + [len(groups) + 1] for groups in _each(sizes, room, least)], dtype=object)


def _in_groups(items: Column, edges: Column) -> Column:
    """The items of each group, as an array of arrays."""
    return F.transform(F.slice(edges, 1, F.size(edges) - 1), lambda at, i: F.slice(items, at, F.element_at(edges, i + 2) - at))


_ANY = float(1 << 53)


def greedy_groups(sizes: Column, budget: int | Column) -> Column:
    """Group number of each element: elements join the group before while its sum stays within the budget; one that is larger is a group of its own."""
    room = budget if isinstance(budget, Column) else F.lit(budget)
    return _greedy(sizes.cast("array<bigint>"), room.cast("double"), F.lit(_ANY))


#: A table in a text up to the last end mark; marks without a partner are text.
_TABLE = r"(?s)\[TABLE_START\](.*?)\[TABLE_END\]"


def split_structure(docs: DataFrame) -> DataFrame:
    """(file_id, seg, text, is_table): text between tables, and tables whole; blank parts are left out. Two control characters that mark the parts go from the text."""
    bare = docs.select("file_id", F.regexp_replace("text", "[\x01\x02]+", "").alias("text"))
    # no table ends behind the last mark, so that no start looks for its end in vain
    tail = F.length(F.substring_index("text", STOP, -1))
    docs = bare.withColumn("_head", F.length("text") - tail)
    marked = F.concat(F.regexp_replace(F.left("text", F.col("_head")), _TABLE, "\x01\x02$1\x01"), F.substring(F.col("text"), F.col("_head") + 1, F.length("text")))
    parts = docs.select("file_id", F.posexplode(F.split(marked, "\x01")).alias("seg", "part"))
    table = F.startswith("part", F.lit("\x02"))
    inside = F.btrim(F.substring("part", 2, F.length("part")), F.lit(" \t\n\x0b\f\r"))
    out = parts.select("file_id", "seg", F.when(table, inside).otherwise(F.col("part")).alias("text"), table.alias("is_table"))
    return out.where(F.col("text").rlike(r"\S"))


def sentences(text: Column) -> Column:
    """Sentences: a break is a line end, or white space after a full stop, exclamation or question mark."""
    return F.filter(F.split(F.regexp_replace(text, r"([.!?。！？])[ \t]+", "$1\n"), r"\n+"), lambda s: F.length(F.trim(s)) > 0)


_STOP, _LINES, _CONTROL, _CJK = re.compile(r"([.!?。！？])[ \t]+"), re.compile(r"\n+"), re.compile(CONTROL), re.compile("[\u4e00-\u9fff]")


def packed_text(text: str, budget: int) -> list[str]:
    """The `sentences` of a text, joined by spaces up to the budget of `estimate_tokens`: what `greedy_groups` does, in one walk over the text."""
    mixed = _CJK.search(text) is not None
    out, held, total = [], [], 0
    for s in _LINES.split(_STOP.sub("\\1\n", text)):
        if not s.strip(" "):
            continue
        ideographs = len(s) - len(_CJK.sub("", s)) if mixed else 0
        n = int(1.5 * ideographs + 0.3 * (len(s) - ideographs))
        if held and total + n <= budget:
            held.append(s)
            total += n
        else:
            if held:
                out.append(" ".join(held))
            held, total = [s], n
    return [*out, " ".join(held)] if held else out


def _clean_once(chunks: list[str]) -> list[str]:
    """Without control characters, and the first of those that are the same when trimmed."""
    first: dict[str, str] = {}
    for chunk in chunks:
        clean = _CONTROL.sub("", chunk)
        first.setdefault(clean.strip(" "), clean)
    return list(first.values())


def _packs(text: Column, budget: int, once: bool = False) -> Column:
    """The chunks of each text; with `once` clean and each once."""

    def run(texts: pa.Array) -> pa.Array:
        each = [packed_text(t, budget) if t else [] for t in texts.to_pylist()]
        return pa.array([_clean_once(chunks) for chunks in each] if once else each, pa.list_(pa.string()))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.ArrayType(T.StringType()))(text)


def pack_sentences(docs: DataFrame, budget: int = LEAF_TOKENS, overlap: int = 0, different: bool = False) -> DataFrame:
    """(file_id, chunk_index, text): sentences of each document packed up to the budget of tokens.

    With overlap, a chunk begins with the last sentence of the one before, if that has at most so many tokens. different: all file_ids are known to be
    different, so that each text is packed where it lies.
    """
    if different and not overlap:
        return docs.select("file_id", F.posexplode(_packs(F.col("text"), budget)).alias("chunk_index", "text"))
    parts = docs.select("file_id", sentences(F.col("text")).alias("s"))
    grouped = parts.withColumn("g", greedy_groups(F.transform("s", lambda x: estimate_tokens(x)), budget))
    rows = grouped.select("file_id", F.posexplode(F.arrays_zip("s", "g")).alias("pos", "x")).select("file_id", F.col("x.g").alias("chunk_index"), F.col("pos"), F.col("x.s").alias("s"))
    if overlap:
        w = Window.partitionBy("file_id").orderBy("pos")
        rows = rows.withColumns({"_before": F.lag("s").over(w), "_group": F.lag("chunk_index").over(w)})
        carried = (F.col("_group") != F.col("chunk_index")) & (estimate_tokens(F.col("_before")) <= overlap)
        rows = rows.withColumn("s", F.when(carried, F.concat("_before", F.lit(" "), "s")).otherwise(F.col("s")))
    packed = rows.groupBy("file_id", "chunk_index").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("all"))
    return packed.select("file_id", "chunk_index", F.array_join(F.transform("all", lambda x: x["s"]), " ").alias("text"))


def refine_oversized(chunks: DataFrame, budget: int) -> DataFrame:
    """(node_id, part, text): chunks over the budget are cut at lines, long lines at sentences, long sentences by characters.

    A Markdown table's two header lines stand again at the head of each further part, and their cost is kept free.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0)
    marked = chunks.select("node_id", "text", (estimate_tokens(F.col("text")) > budget).alias("over"), lines.alias("lines"))
    table = (F.size("lines") > 2) & F.contains(F.col("lines")[0], F.lit("|")) & F.col("lines")[1].rlike(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)+\|?\s*$")
    marked = marked.withColumn("header", F.when(table, F.concat(F.col("lines")[0], F.lit("\n"), F.col("lines")[1])))
    room = F.greatest(F.lit(budget) - F.coalesce(estimate_tokens(F.col("header")), F.lit(0)), F.lit(32))
    width = F.greatest((room / 1.5).cast("int"), F.lit(1))  # no character costs more than 1.5 tokens

    def cut(piece: Column) -> Column:
        fixed = F.transform(F.sequence(F.lit(0), F.ceil(F.length(piece) / width).cast("int") - 1), lambda i: F.substring(piece, i * width + 1, width))
        return F.when(estimate_tokens(piece) <= room, F.array(piece)).otherwise(fixed)

    def by_sentence(line: Column) -> Column:
        return F.when(estimate_tokens(line) <= room, F.array(line)).otherwise(F.flatten(F.transform(sentences(line), cut)))

    body = F.when(F.col("header").isNotNull(), F.slice("lines", 3, F.size("lines"))).otherwise(F.col("lines"))
    pieces = marked.withColumn("pieces", F.when(F.col("over"), F.flatten(F.transform(body, by_sentence))).otherwise(F.array("text")))
    sizes = F.transform("pieces", lambda x: estimate_tokens(x) + 1).cast("array<bigint>")
    grouped = pieces.withColumn("e", F.when(F.col("over"), _edges(sizes, room.cast("double"), F.lit(_ANY))).otherwise(F.array(F.lit(1), F.lit(2))))
    parts = grouped.select("node_id", "header", "over", F.posexplode(F.transform(_in_groups(F.col("pieces"), F.col("e")), lambda x: F.array_join(x, "\n"))).alias("part", "body"))
    return parts.select("node_id", "part", F.when(F.col("header").isNotNull() & F.col("over"), F.concat("header", F.lit("\n"), "body")).otherwise(F.col("body")).alias("text"))


def merge_small(chunks: DataFrame, budget: int, tokens: Column | None = None) -> DataFrame:
    """(file_id, chunk_index, text, page_no, merged): neighbours below half the budget are put together until they reach it; the first one's page counts.

    A chunk of half the budget or more stands alone and ends the run before it.
    """
    cost = tokens if tokens is not None else estimate_tokens(F.col("text"))
    rows = chunks.select("file_id", F.struct("chunk_index", "text", "page_no", cost.alias("n")).alias("x"))
    each = rows.groupBy("file_id").agg(F.array_sort(F.collect_list("x")).alias("all"))
    sizes = F.transform("all", lambda x: x["n"]).cast("array<bigint>")
    grouped = each.withColumn("e", _edges(sizes, F.lit(_ANY), F.lit(budget / 2)))
    packed = grouped.select("file_id", F.posexplode(_in_groups(F.col("all"), F.col("e"))).alias("chunk_index", "all"))
    return packed.select("file_id", "chunk_index", F.array_join(F.transform("all", lambda x: x["text"]), "\n").alias("text"), F.col("all")[0]["page_no"].alias("page_no"), F.size("all").alias("merged"))


def clean_leaves(chunks: DataFrame, counters: Observation | None = None) -> DataFrame:
    """Chunks (file_id, chunk_index, text) without control characters, blanks, low-value ones and repeats; counters gets what was seen and what was low in value."""
    from .ranking import dedup_leaves

    cleaned = chunks.withColumn("text", clean_text(F.col("text"))).withColumn("_low", is_low_value(F.col("text")))
    if counters is not None:
        cleaned = cleaned.observe(counters, F.count("*").alias("seen"), F.count_if("_low").alias("low_value"))
    return dedup_leaves(cleaned.where(~F.col("_low")).drop("_low"))


def _node(role: str, at: Column) -> Column:
    return F.sha2(F.concat_ws("|", "file_id", F.lit(role), at.cast("string")), 256)


def build_hierarchy(leaves: DataFrame, budget: int = PARENT_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(leaves, parents): consecutive leaves of a file share a parent while their tokens fit its budget.

    leaves: (file_id, chunk_index, text). Leaves get a new chunk_index without gaps, node_id, parent_node_id, n_tokens and total_chunks;
    parents have node_id, text (leaves joined by a blank line), children_start, children_end and chunk_count. Ids are hashes of file and place.
    """
    numbered = leaves.withColumn("n_tokens", estimate_tokens(F.col("text")))
    folded = numbered.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "n_tokens"))).alias("all"))
    folded = folded.withColumn("g", greedy_groups(F.transform("all", lambda x: x["n_tokens"]), budget)).withColumn("total_chunks", F.size("all"))
    places = folded.select("file_id", "total_chunks", F.posexplode(F.arrays_zip("all", "g")).alias("place", "x"))
    places = places.select("file_id", "total_chunks", "place", F.col("x.all.chunk_index").alias("chunk_index"), F.col("x.g").alias("parent"))
    out = numbered.join(places, ["file_id", "chunk_index"]).drop("chunk_index").withColumnRenamed("place", "chunk_index")
    out = out.withColumns({"node_id": _node("leaf", F.col("chunk_index")), "parent_node_id": _node("parent", F.col("parent"))})
    parents = out.groupBy("file_id", "parent", F.col("parent_node_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text", "node_id"))).alias("all"))
    parents = parents.select(
        "file_id", "node_id", F.array_join(F.transform("all", lambda x: x["text"]), "\n\n").alias("text"), F.transform("all", lambda x: x["node_id"]).alias("children_node_ids"),
        F.col("all")[0]["chunk_index"].alias("children_start"), F.element_at("all", -1)["chunk_index"].alias("children_end"), F.size("all").alias("chunk_count"),
    )
    return out.drop("parent"), parents


def split_failures(docs: DataFrame, leaves: DataFrame) -> DataFrame:
    """Documents without any leaf: failed, with a reason."""
    return docs.select("file_id").join(leaves.select("file_id").distinct(), "file_id", "left_anti").withColumn("error", F.lit("no chunks"))


def chunk_corpus(docs: DataFrame, leaf_tokens: int = LEAF_TOKENS, parent_tokens: int = PARENT_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(leaves, parents) of documents (file_id, text), as `pack_sentences`, `clean_leaves` and `build_hierarchy` make them.

    Where all file_ids are different, each text is cut where it lies, and its chunks are written once; leaves and parents are read from that.
    """
    if not docs.groupBy("file_id").count().where("count > 1 OR file_id IS NULL").isEmpty():
        return build_hierarchy(clean_leaves(pack_sentences(docs, leaf_tokens)), parent_tokens)
    cut = docs.select("file_id", F.filter(_packs(F.col("text"), leaf_tokens, once=True), lambda t: ~is_low_value(t)).alias("text"))
    cut = cut.withColumn("n", F.transform("text", lambda t: estimate_tokens(t)))
    sizes = F.col("n").cast("array<bigint>")
    cut = Scratch(docs.sparkSession, "cut").keep(cut.withColumns({"parent": greedy_groups(sizes, parent_tokens), "start": _edges(sizes, F.lit(float(parent_tokens)), F.lit(_ANY))}))
    leaves = cut.select("file_id", F.size("text").alias("total_chunks"), F.posexplode(F.arrays_zip("text", "n", "parent")).alias("chunk_index", "x"))
    leaves = leaves.select("file_id", "x.text", F.col("x.n").alias("n_tokens"), "total_chunks", "chunk_index", _node("leaf", F.col("chunk_index")).alias("node_id"), _node("parent", F.col("x.parent")).alias("parent_node_id"))
    groups = F.arrays_zip(_in_groups(F.col("text"), F.col("start")).alias("all"), F.slice("start", 1, F.size("start") - 1).alias("start"))
    parents = cut.select("file_id", F.posexplode(groups).alias("parent", "x")).select("file_id", "parent", (F.col("x.start") - 1).alias("children_start"), F.col("x.all").alias("all"))
    end = F.col("children_start") + F.size("all") - 1
    parents = parents.select(
        "file_id", _node("parent", F.col("parent")).alias("node_id"), F.array_join("all", "\n\n").alias("text"), F.transform(F.sequence("children_start", end), lambda i: _node("leaf", i)).alias("children_node_ids"),
        "children_start", end.alias("children_end"), F.size("all").alias("chunk_count"),
    )
    return leaves, parents


def structured_chunks(docs: DataFrame, leaf_tokens: int = LEAF_TOKENS) -> DataFrame:
    """(file_id, chunk_index, text) of documents with different file_ids: tables whole and sentences packed between them, what is over the budget cut, small neighbours merged, clean."""
    parts = split_structure(docs.withColumn("text", clean_text(F.col("text"))))
    place = F.struct("file_id", "seg").alias("file_id")
    packed = pack_sentences(parts.where("NOT is_table").select(place, "text"), leaf_tokens, different=True)
    tables = parts.where("is_table").select(place, F.lit(0).alias("chunk_index"), "text")
    pieces = refine_oversized(packed.unionByName(tables).select(F.struct("file_id.file_id", "file_id.seg", "chunk_index").alias("node_id"), "text"), leaf_tokens)
    small = pieces.select(F.col("node_id.file_id").alias("file_id"), F.struct("node_id.seg", "node_id.chunk_index", "part").alias("chunk_index"), "text", F.lit(None).cast("int").alias("page_no"))
    return clean_leaves(merge_small(small, leaf_tokens).select("file_id", "chunk_index", "text"))


def with_context(leaves: DataFrame, prefix: Column, file_name: Column) -> DataFrame:
    """Leaves whose text has a prefix that tells where it stands, the file name where the prefix fails."""
    return leaves.withColumn("text", contextualize(F.col("text"), prefix, file_name))


def table_cells(chunks: DataFrame) -> DataFrame:
    """(node_id, row, col, value) from a Markdown pipe table, or from triplets `row, column = value`.

    In a pipe table the first line names the columns and the first cell of a line its row.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.lit("|")) & ~x.rlike(r"^[\s|:-]+$"))
    cells = lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    pipes = chunks.where(F.size(lines) >= 2).select("node_id", cells(lines[0]).alias("head"), F.explode(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1)))).alias("line"))
    pipes = pipes.select("node_id", "head", cells(F.col("line")).alias("cells"))
    pipes = pipes.select("node_id", F.col("cells")[0].alias("row"), F.posexplode(F.arrays_zip("head", "cells")).alias("pos", "x")).where("pos > 0").select("node_id", "row", F.col("x.head").alias("col"), F.col("x.cells").alias("value"))
    pattern = r"([^,.=\n]+), ([^,=\n]+) = ((?:[^.\n]|\.(?=[0-9]))+)"
    triples = chunks.where(F.size(lines) < 2).select("node_id", F.explode(F.arrays_zip(*[F.regexp_extract_all("text", F.lit(pattern), F.lit(i)).alias(n) for i, n in ((1, "row"), (2, "col"), (3, "value"))])).alias("t"))
    return pipes.unionByName(triples.select("node_id", *[F.trim(F.col(f"t.{n}")).alias(n) for n in ("row", "col", "value")]))


def provenance(chunks: DataFrame) -> DataFrame:
    """content_type, page_no and heading path from items ARRAY<STRUCT<label, page_no, heading>>: a table wins over a picture, that over text."""
    any_ = lambda label: F.exists("items", lambda x: x["label"] == label)
    kind = F.when(any_("table"), "table").when(any_("picture"), "picture").otherwise("text")
    page = F.get(F.filter(F.transform("items", lambda x: x["page_no"]), lambda p: p.isNotNull()), F.lit(0))
    return chunks.select("node_id", kind.alias("content_type"), page.alias("page_no"), F.array_distinct(F.filter(F.transform("items", lambda x: x["heading"]), lambda h: h.isNotNull())).alias("headings"))


#: Elements that end a block, and those whose content is no text.
BREAKS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol table tr td th article section nav footer header br body html main aside".split())
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in ("script", "style")}
#: The rest of a tag behind its name: quoted values may have any character. None of its parts can match in two ways.
_REST = re.compile(r"""(?:[^>"'=]|=\s*(?:"[^"]*"|'[^']*')|["'=])*+>""")
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")


def visible_blocks(html: str) -> list[tuple[str, list[str]]]:
    """(text, path of headings) of the visible blocks of a page, in one walk from left to right that reads no character more often than a fixed number of times.

    Scripts, styles, the head and comments are left out; what is left open reaches to the end of the page. Character references are decoded in each piece of text between
    two marks by itself. White space inside a block becomes one space.
    """
    blocks: list[tuple[str, list[str]]] = []
    path: dict[int, str] = {}
    text: list[str] = []
    level, at, hidden = 0, 0, False

    def end() -> None:
        nonlocal level
        found = " ".join("".join(text).split())
        text.clear()
        if found:
            if level:
                for k in [k for k in path if k >= level]:
                    del path[k]
                path[level] = found
            blocks.append((found, [path[k] for k in sorted(path)]))
        level = 0

    while at < len(html):
        mark = html.find("<", at)
        piece = html[at:] if mark < 0 else html[at:mark]
        if piece and not hidden:
            text.append(unescape(piece))
        if mark < 0:
            break
        tag = _NAME.match(html, mark + 1)
        if html.startswith("<!--", mark):
            stop = html.find("-->", mark + 4)
            at = len(html) if stop < 0 else stop + 3
        elif tag is None:
            if html[mark + 1 : mark + 2] in ("!", "?", "/"):
                stop = html.find(">", mark)
                at = len(html) if stop < 0 else stop + 1
            else:  # a sign of its own
                if not hidden:
                    text.append("<")
                at = mark + 1
        else:
            rest = _REST.match(html, tag.end())
            if rest is None:
                break  # a tag that never ends
            at, name, closes = rest.end(), tag[1].lower(), html[mark + 1] == "/"
            if name in BREAKS:
                hidden = hidden and name != "body"
                if not hidden:
                    end()
                    level = int(name[1]) if not closes and name[0] == "h" and name[1:].isdigit() else 0
            elif name == "head":
                hidden = not closes
            elif name in _RAW and not closes:
                stop = _RAW[name].search(html, at)
                at = len(html) if stop is None else stop.start()
    end()
    return blocks


def html_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block_index, text, heading, headings): visible blocks of pages with the heading they stand under and those above it (`visible_blocks`); a null page has none."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = visible_blocks(batch.column("html")[i].as_py() or "")
                if found:
                    ids = batch.column("page_id").take(pa.array([i] * len(found)))
                    columns = [ids, pa.array(range(len(found)), pa.int32()), pa.array([t for t, _ in found], pa.string()), pa.array([h[-1] if h else None for _, h in found], pa.string()), pa.array([h for _, h in found], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["page_id", "block_index", "text", "heading", "headings"])

    return pages.select("page_id", F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kind}, block_index int, text string, heading string, headings array<string>")


def register_table_cells(spark, name: str = "table_cells") -> None:
    """A table function for SQL: rows (row, col, value) of a Markdown pipe table, as `table_cells` finds them."""

    class Cells:
        def eval(self, text: str):
            lines = [x for x in (text or "").split("\n") if "|" in x and x.strip(" \t|:-")]
            split = lambda x: [c.strip() for c in x.strip().removeprefix("|").removesuffix("|").split("|")]
            for line in lines[1:]:
                cells = split(line)
                for head, cell in list(zip(split(lines[0]), cells, strict=False))[1:]:
                    yield cells[0], head, cell

    spark.udtf.register(name, F.udtf(Cells, returnType="row string, col string, value string"))
