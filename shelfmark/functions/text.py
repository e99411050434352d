"""Column functions over text. All stay inside the JVM; NULL gives NULL unless stated."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"\x{4e00}-\x{9fff}"
#: White space as the strip of a Unicode-aware language sees it.
BLANKS = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# Code-point ranges of the scripts that are told apart.
SCRIPTS = {
    "Arabic": r"\x{0600}-\x{06ff}",
    "CJK": r"\x{4e00}-\x{9fff}",
    "Cyrillic": r"\x{0400}-\x{04ff}",
    "Devanagari": r"\x{0900}-\x{097f}",
    "Hangul": r"\x{ac00}-\x{d7af}",
    "Hebrew": r"\x{0590}-\x{05ff}",
    "Hiragana": r"\x{3040}-\x{309f}",
    "Katakana": r"\x{30a0}-\x{30ff}",
    "Latin": r"\x{0041}-\x{005a}\x{0061}-\x{007a}\x{00c0}-\x{024f}",
    "Thai": r"\x{0e00}-\x{0e7f}",
}
# Phrases that speech recognition invents over music or silence; below, strings of which a text with the phrase has one.
NOISE = [
    r"[词詞][・·•\s]{0,3}作曲[・·•\s]{0,3}[编編]曲\s*[\x{4e00}-\x{9fff}]{0,15}",
    r"(?:[请請]不吝[点點][赞讚][^。\n]{0,40}?明[镜鏡][与與][点點][点點][^。\n]{0,15}?[栏欄]目[\s,、。]*)+",
    r"打[赏賞]支持[^。\n]{0,20}?[栏欄]目[\s,、。]*",
    r"[请請][订訂][阅閱][^。\n]{0,20}?(?:[频頻][道台]|频道)[\s,、。]*",
    r"[感][谢謝][观觀]看[本这這的][^。\n]{0,15}",
    r"字幕由[^。\n]{0,30}?Amara[^。\n]{0,30}",
    r"由志[愿願]者[^。\n]{0,15}?[提組]供",
    r"字幕志[愿願]者[^。\n]{0,30}",
]
NOISE_MARKS = [["作曲"], ["不吝"], ["支持"], ["阅", "閱"], ["看"], ["Amara"], ["由志"], ["字幕志"]]
# A phrase said again, control characters, what chunks of mere structure are made of, an empty code fence, and what an error rate leaves out.
REPEATED = r"([\x{4e00}-\x{9fff}]{3,30})(?:[\s,，。、!?！？]*\1){2,}"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
STRUCTURE = r"[ \t\r\n`#|>*_~\-→▪●·•]+"
BODY = STRUCTURE.replace("[", "[^", 1).removesuffix("+")
FENCE = r"\n[ \t\r\n]*```[a-zA-Z0-9_+-]*[ \t\r\n]*$"
PUNCTUATION = r"""[\s,，。.、;；:：!！?？"'「」『』()（）\-—·…]+"""
# Characters that only simplified Chinese has (a sample).
SIMPLIFIED = "会议记录检统计设进军对开关买卖东车书长门问间闻风飞马鸟龙点级红绿语说读写听讲话让认识谁请谢边这远运动过还货质银钱铁钟错难题华万与专业丛严个临为丽举义乐习乡产亲亿仅从仓仪们价众优传伤体办务"


def _once(value: Column, what: Callable[[Column], Column]) -> Column:
    """what(value), where the value is made once however often it is used."""
    return F.element_at(F.transform(F.array(value), what), 1)


def clean_text(text: Column) -> Column:
    """Without NUL and control characters; line feed, tab and carriage return stay."""
    return F.regexp_replace(text, CONTROL, "")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def is_low_value(text: Column) -> Column:
    """Has a chunk nothing to retrieve: blank, only structure, or an empty code fence after fewer than 40 characters? NULL counts as blank."""

    def low(bare: Column) -> Column:
        fenced = F.contains(bare, F.lit("```")) & bare.rlike(FENCE)
        body = F.regexp_replace(bare, FENCE, "")
        return F.when(fenced, F.length(F.regexp_replace(body, STRUCTURE, "")) < 40).otherwise(~bare.rlike(BODY))

    thorough = _once(strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x{200b}\x{200c}\x{200d}\x{feff}]+", "")), low)
    plain = text.rlike("[A-Za-z0-9]") & ~F.contains(text, F.lit("```"))  # most texts, known by their first letter
    return F.when(plain, False).otherwise(thorough)


def _has_ideographs(text: Column) -> Column:
    """An ideograph takes three bytes, so that most texts are told by their sizes."""
    return (F.octet_length(text) - F.length(text) >= 2) & text.rlike(f"[{CJK}]")


def _ideographs(text: Column) -> Column:
    return F.regexp_replace(text, f"[^{CJK}]+", "")


def estimate_tokens(text: Column) -> Column:
    """1.5 for each CJK ideograph and 0.3 for each other character, cut to an integer."""
    cjk = F.length(_ideographs(text))
    mixed = F.lit(1.5) * cjk + F.lit(0.3) * (F.length(text) - cjk)
    return F.floor(F.when(_has_ideographs(text), mixed).otherwise(F.lit(0.3) * F.length(text))).cast("int")


def detect_scripts(text: Column) -> Column:
    """Names of the scripts that a text's letters belong to, in order."""
    return F.array_compact(F.array(*[F.when(text.rlike(rf"[{chars}&&\p{{L}}]"), F.lit(name)) for name, chars in SCRIPTS.items()]))


def script_mismatch(chunk: Column, prefix: Column) -> Column:
    """Has a chunk a script other than Latin, and its prefix none?"""
    other = lambda c: F.size(F.array_except(detect_scripts(c), F.array(F.lit("Latin"))))
    return (other(chunk) > 0) & (other(prefix) == 0)


def contextualize(text: Column, prefix: Column, file_name: Column) -> Column:
    """The prefix (150 characters at most) and a blank line before the text; the file name where the prefix is missing or of another script."""
    fallback = F.coalesce(F.length(strip(prefix)) == 0, F.lit(True)) | script_mismatch(text, F.coalesce(prefix, F.lit("")))
    return F.concat(F.when(fallback, file_name).otherwise(F.left(strip(prefix), F.lit(150))), F.lit("\n\n"), text)


def clip_document(text: Column, most: int = 60_000, marker: str = "\n[truncated]") -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(marker))).otherwise(text)


def tokenize(text: Column) -> Column:
    """Lower-case tokens: runs of letters, digits and underscores; a run of CJK ideographs gives its characters and pairs of neighbours."""
    words = lambda lower: F.array_remove(F.split(lower, r"[^\p{L}\p{M}\p{N}_]+"), "")
    spaced = F.regexp_replace(F.lower(text), f"([{CJK}]+)", " $1 ")

    def pieces(w: Column) -> Column:
        n = F.length(w)
        single = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(w, i, F.lit(1)))
        pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(w, i, F.lit(2)))
        return F.when(~w.rlike(f"^[{CJK}]"), F.array(w)).when(n == 1, single).otherwise(F.concat(single, pairs))

    return F.when(_has_ideographs(text), F.flatten(F.transform(words(spaced), pieces))).otherwise(words(F.lower(text)))


def or_query(text: Column) -> Column:
    """Distinct tokens of a query; the raw text where there are none."""
    tokens = F.array_distinct(tokenize(text))
    return F.when(F.size(tokens) > 0, tokens).otherwise(F.array(text))


def with_prefix(text: Column, role: str) -> Column:
    """`query: ` or `passage: ` before a text for a model that expects it."""
    return F.concat(F.lit(f"{role}: "), text)


def apply_template(template: Column, text: Column) -> Column:
    return F.replace(template, F.lit("{text}"), text)


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parameters joined by bars, NULL as `default`."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("default")) for p in parts]), 256)


def owner_key(token: Column) -> Column:
    """The claim jti of a token's payload, else the token's SHA-256. Signatures are checked elsewhere."""
    part = F.translate(F.split_part(token, F.lit("."), F.lit(2)), "-_", "+/")
    padded = F.rpad(part, (F.ceil(F.length(part) / 4) * 4).cast("int"), F.lit("="))
    claim = F.get_json_object(F.try_to_binary(padded, F.lit("base64")).cast("string"), "$.jti")
    return F.when((F.size(F.split(token, r"\.")) == 3) & (F.length(claim) > 0), claim).otherwise(F.sha2(token, 256))


def clean_transcript(text: Column) -> Column:
    """STRUCT(text, n): known noise removed, a phrase of 3 to 30 ideographs said three times or more kept once; n counts what was removed."""
    out = F.struct(text.alias("text"), F.when(text.isNotNull(), 0).alias("n"))

    def without(pattern: str, marks: list[str]) -> Callable[[Column], Column]:
        cut = lambda s: _once(F.split(s["text"], pattern, -1), lambda parts: F.struct(F.array_join(parts, "").alias("text"), (s["n"] + F.size(parts) - 1).alias("n")))
        return lambda s: F.when(reduce(lambda a, b: a | b, [F.contains(s["text"], F.lit(m)) for m in marks]), cut(s)).otherwise(s)

    for pattern, marks in zip(NOISE, NOISE_MARKS, strict=True):
        out = _once(out, without(pattern, marks))

    def said_once(s: Column) -> Column:
        phrases = F.regexp_extract_all(s["text"], F.lit(REPEATED), F.lit(1))
        copies = lambda repeated: F.zip_with(repeated, phrases, lambda r, p: ((F.length(r) - F.length(F.replace(r, p, F.lit("")))) / F.length(p)).cast("int") - 1)
        some = lambda r: F.struct(F.regexp_replace(s["text"], REPEATED, "$1").alias("text"), (s["n"] + F.aggregate(copies(r), F.lit(0), lambda a, c: a + c)).alias("n"))
        return _once(F.regexp_extract_all(s["text"], F.lit(REPEATED), F.lit(0)), lambda r: F.when(F.size(r) > 0, some(r)).otherwise(s))

    return _once(out, said_once)


def cer(reference: Column, hypothesis: Column) -> Column:
    """Edits for each character of the reference after punctuation and blanks are removed; an empty reference gives 0 or 1."""
    bare = lambda c: F.regexp_replace(c, PUNCTUATION, "")
    a, b = bare(reference), bare(hypothesis)
    return F.when(F.length(a) == 0, F.when(F.length(b) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(a, b) / F.length(a))


def simplified_ratio(text: Column) -> Column:
    share = lambda cjk: F.when(F.length(cjk) == 0, 0.0).otherwise(F.length(F.regexp_replace(cjk, f"[^{SIMPLIFIED}]+", "")) / F.length(cjk))
    return _once(_ideographs(text), share)


def parse_grades(answer: Column, n: Column) -> Column:
    """The first JSON array of booleans in a model's answer, cut or filled with false to n; all true if there is none."""
    found = F.from_json(F.regexp_extract(answer, r"(?s)\[.*?\]", 0), "array<boolean>")
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.coalesce(F.try_element_at(found, i), F.lit(False)))
    every = F.transform(F.sequence(F.lit(1), n), lambda i: F.lit(True))
    return F.when(n <= 0, F.array().cast("array<boolean>")).otherwise(F.when(found.isNull(), every).otherwise(each))


def parse_scores(answer: Column) -> Column:
    """STRUCT(faithfulness, relevance) from the JSON object in a model's answer, held between 0 and 1; NULL where missing."""
    found = F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), "faithfulness double, relevance double")
    held = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
    return F.struct(held(found["faithfulness"]).alias("faithfulness"), held(found["relevance"]).alias("relevance"))


def normalize_citations(text: Column) -> Column:
    return F.regexp_replace(text, r"【\s*([0-9]+)\s*†[^】]*】", "[$1]")


def is_safe_name(name: Column) -> Column:
    """Only letters, digits, `_`, `-`, `.` and blanks; no leading dot and no two dots in a row. NULL is not safe."""
    return F.coalesce(name.rlike(r"^[\p{L}\p{N}_\-. ]+$") & ~F.contains(name, F.lit("..")) & ~F.startswith(name, F.lit(".")), F.lit(False))


def mask_token(token: Column) -> Column:
    return F.when(F.length(token) > 8, F.concat(F.left(token, F.lit(8)), F.lit("..."))).otherwise(token)


def brief_error(text: Column) -> Column:
    return F.when(F.length(text) > 300, F.concat(F.left(text, F.lit(300)), F.lit("…"))).otherwise(text)


def size_kb(size: Column) -> Column:
    return F.round(size / 1024, 1)


def rename_prefix(path: Column, old: str, new: str) -> Column:
    """A path with its leading folder renamed."""
    return F.when(F.startswith(path, F.lit(f"{old}/")), F.concat(F.lit(f"{new}/"), F.substring(path, F.lit(len(old) + 2), F.length(path)))).otherwise(path)


def next_hint(count: Column, top_k: Column) -> Column:
    """What a searcher may do next, by the number of results."""
    return F.when(count == 0, "no_results").when(count < top_k, "below_top_k").otherwise("normal")
