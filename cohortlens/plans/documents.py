"""Documents: HTML sections, chunks, sentence repair, checks, consuming matches."""

from __future__ import annotations

import re
from collections.abc import Sequence
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.memory import rows_of
from ..functions.text import locate_all
from ..operators.joins import contains_terms

_HEADINGS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6}
_SKIPPED = {"script", "style", "nav", "aside", "footer", "noscript"}
_BLOCKS = {"p", "div", "li", "td", "th", "tr", "section", "article", "br", "table", "ul", "ol"}


class _Sections(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out = [{"level": 0, "title": "", "text": []}]
        self.skip, self.heading = 0, ""

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED:
            self.skip += 1
        elif tag in _HEADINGS and not self.skip:
            self.heading = tag
            self.out.append({"level": _HEADINGS[tag], "title": "", "text": []})
        elif tag in _BLOCKS and not self.heading:
            self.out[-1]["text"].append(" ")

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == self.heading:
            self.heading = ""
        elif tag in _BLOCKS and not self.heading:
            self.out[-1]["text"].append(" ")

    def handle_data(self, data):
        if self.skip:
            return
        if self.heading:
            self.out[-1]["title"] += data
        else:
            self.out[-1]["text"].append(data)


def parse_sections(html: str | None) -> list[dict]:
    """Sections of a page in order: pos, level of the heading (0 before the first), title, text. Never fails."""
    if not html:
        return []
    parser = _Sections()
    parser.feed(html)
    parser.close()
    squeeze = lambda s: re.sub(r"\s+", " ", s).strip()
    own = [(s["level"], squeeze(s["title"]), squeeze("".join(s["text"]))) for s in parser.out]
    own = [s for s in own if s[1] or s[2]]
    return [{"pos": k, "level": lv, "title": title, "text": text} for k, (lv, title, text) in enumerate(own)]


# Columns of a section.
SECTION = {"pos": "int", "level": "int", "title": "string", "text": "string"}


def section_rows(sections: list[dict]) -> list[tuple]:
    return [tuple(s[name] for name in SECTION) for s in sections]


def html_sections(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, level, title, text): a row for each section."""

    return rows_of(pages, [key], html, lambda page: section_rows(parse_sections(page)), SECTION)


def chunk(text: str | None, limit: int = 400) -> list[str]:
    """Greedy pieces of at most ``limit`` words: paragraphs, then lines, sentences, words where one is too long."""
    if not text:
        return []
    out: list[str] = []

    def pack(pieces: list[str], sep: str, finer: int) -> None:
        held: list[str] = []
        size = 0
        for piece in pieces:
            n = len(piece.split())
            if n == 0:
                continue
            if size + n > limit and held:
                out.append(sep.join(held))
                held, size = [], 0
            if n > limit:
                split(piece, finer)
            else:
                held.append(piece.strip())
                size += n
        if held:
            out.append(sep.join(held))

    def split(piece: str, level: int) -> None:
        if level == 0:
            pack(re.split(r"\n\s*\n", piece), "\n\n", 1)
        elif level == 1:
            pack(piece.split("\n"), "\n", 2)
        elif level == 2:
            pack(re.split(r"(?<=[.!?])\s+", piece), " ", 3)
        else:
            words = piece.split()
            out.extend(" ".join(words[k : k + limit]) for k in range(0, len(words), limit))

    split(text, 0)
    return out


def chunks(df: DataFrame, key: str, text: str, limit: int = 400) -> DataFrame:
    """(key, pos, chunk): a row for each piece of a text."""
    return rows_of(df, [key], text, lambda t: enumerate(chunk(t, limit)), {"pos": "int", "chunk": "string"})


# What a piece begins or ends with that goes on.
CONJUNCTIONS = ("and", "or", "but")
STARTS = ("<", "×", "=", ">", "≤", "≥", "±", "+", "−", "–", "~", "-", ",", ":", ";")
ENDS = ("<", "×", "=", ">", "≤", "≥", "±", "+", "−", "–", "~", "-", ",", ":", ";", "vs.", "e.g.", "i.e.")
_WORD_START = re.compile(rf"\s*(?:{'|'.join(CONJUNCTIONS)})\b")
_WORD_END = re.compile(rf"\b(?:{'|'.join(CONJUNCTIONS)})\s*$")
_LONE = re.compile(r"[\s.,)\]}!?\u201d\u201c]+")
_CITED = r"\d+(?:\s*[,\-–]\s*\d+)*"
# Patterns that leave a sentence, in order: section numbers, citations at the end, at the start, and within.
_STRIPPED = [
    (re.compile(r"^\d+(?:\.\d+)*\.\s*"), ""),
    (re.compile(r"\[\d+\](\.?)$"), r"\1"),
    (re.compile(r"(?<!\d)\.\d+(?:[-,]\d+)*\s*$"), "."),
    (re.compile(r"^\s*\(\d+(?:[,\s]\d+)*\)\s+(?=[A-Z])"), ""),
    (re.compile(r"^\s*\d+(?:[-,]\d+)*\s+(?=[A-Z])"), ""),
    (re.compile(rf"\s*\[{_CITED}\]"), ""),
    (re.compile(rf"(?<=[a-zA-Z.])\s*\({_CITED}\)"), ""),
    (re.compile(r"  +"), " "),
]


def _open(s: str) -> int:
    """Brackets that are opened less those that are closed."""
    return sum((c in "([") - (c in ")]") for c in s)


def _short_close(before: str, s: str) -> bool:
    return len(s) < 50 and s.rstrip(".").endswith((")", "]")) and _open(s) < 0


# Passes over the pieces, in order: whether a piece belongs to the one before it.
_JOINS = [
    lambda before, s: s.startswith("”") and "“" in before and before.endswith("."),
    lambda before, s: _LONE.fullmatch(s) is not None,
    lambda before, s: s.startswith(STARTS),
    lambda before, s: before.endswith(ENDS),
    lambda before, s: _WORD_START.match(s) is not None,
    lambda before, s: _WORD_END.search(before) is not None,
    _short_close,
    lambda before, s: _open(before) > 0,
]
_LAST_JOINS = [
    _short_close,
    lambda before, s: before[-1] in ")]" and s[0].islower(),
    lambda before, s: s[0] in ")]" and not before.endswith("."),
]


def _join(pieces: list[str], belongs) -> list[str]:
    out: list[str] = []
    for s in pieces:
        if out and belongs(out[-1], s):
            out[-1] += ("" if _LONE.fullmatch(s) else " ") + s
        else:
            out.append(s)
    return out


def repair_sentences(parts: Sequence[str]) -> list[str]:
    """Pieces of a splitter as sentences: what belongs to the piece before is put there, pass by pass, then numbers of sections and citations leave, then what that opened is joined."""
    own = [s for s in (p.strip() for p in parts) if s]
    for belongs in _JOINS:
        own = _join(own, belongs)
    for pattern, by in _STRIPPED:
        own = [s for s in (pattern.sub(by, s).strip() for s in own) if s]
    for belongs in _LAST_JOINS:
        own = _join(own, belongs)
    return own


def repaired(df: DataFrame, keys: list[str], parts: str) -> DataFrame:
    """(keys, pos, sentence): a row for each sentence that the pieces of an array make."""
    return rows_of(df, keys, parts, lambda a: enumerate(repair_sentences(a or [])), {"pos": "int", "sentence": "string"})


def consume(c: Column, patterns: Sequence[tuple[str, str]], none: str = "NR") -> Column:
    """Ordered (pattern, label): each pattern that still matches gives its label and takes all its matches away."""
    state = F.struct(c.alias("rest"), F.array().cast("array<string>").alias("found"))
    for pattern, label in patterns:
        hit = state["rest"].rlike(pattern)
        state = F.struct(F.regexp_replace(state["rest"], pattern, "").alias("rest"), F.when(hit, F.array_append(state["found"], F.lit(label))).otherwise(state["found"]).alias("found"))
    return F.when(c.isNotNull(), F.when(F.size(state["found"]) > 0, F.array_join(state["found"], "; ")).otherwise(F.lit(none)))


# What is counted in a text, and whether finding it fails the text.
CHECKS = [
    ("empty_brackets", r"\[\s*\]", "issue"),
    ("empty_parens", r"\(\s*\)", "issue"),
    ("et_al", r"\([A-Z][a-zA-Z\s&,;.]+et al[,;\s.]*\)", "issue"),
    ("number_brackets", r"\[\s*\d+\s*(?:,\s*\d+\s*)*\]", "warning"),
    ("space_period", r" \.", "issue"),
    ("space_comma", r" ,", "issue"),
    ("space_semicolon", r" ;", "issue"),
    ("double_space", r"  +", "warning"),
    ("space_in_parens", r"\(\s+|\s+\)", "issue"),
    ("double_period", r"\.\.+", "issue"),
    ("double_comma", r",,+", "issue"),
    ("dash_comma", r"[–—\-]\s*,", "issue"),
    ("usepackage", r"\\usepackage", "issue"),
    ("documentclass", r"\\documentclass", "issue"),
    ("begin_document", r"\\begin\{document\}", "issue"),
    ("section_numbers", r"(?:^|\. )(\d+\.)+\d*\s+[A-Z]", "warning"),
]
# Families of accessions.
ACCESSIONS = [
    ("dbgap", r"\bphs\d+(?:\.v\d+)?(?:\.p\d+)?"),
    ("ega", r"\bEGA[CDFS]\d+"),
    ("jgas", r"\bJGAS\d+|JGAD\d+"),
    ("prj", r"\bPRJEB\d+|PRJNA\d+"),
    ("nct", r"\bNCT\d{8}"),
]


def text_checks(df: DataFrame, key: str, text: str) -> DataFrame:
    """Counters of a text's flaws, how many sorts are issues and how many warnings (double spaces: over 50), and whether it passes: no issue."""
    own = df.select(key, *[F.regexp_count(text, F.lit(pattern)).cast("long").alias(name) for name, pattern, _ in CHECKS])
    many = lambda kind: sum((F.col(n) > (50 if n == "double_space" else 0)).cast("int") for n, _, k in CHECKS if k == kind)
    return own.withColumns({"n_issues": many("issue"), "n_warnings": many("warning")}).withColumn("passes", F.col("n_issues") == 0)


def accessions(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, family, accession): every mention of each family."""
    found = F.array(*[F.struct(F.lit(name).alias("family"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all")) for name, pattern in ACCESSIONS])
    own = df.select(*keys, F.explode(found).alias("x")).select(*keys, "x.family", F.explode("x.all").alias("accession"))
    return own


# Headings that begin and end the methods, and what methods speak of.
METHOD_HEADING = r"(?i)\b(methods?|materials|methodology|procedures?|participants|subjects)\b"
STOP_HEADING = r"(?i)\b(results?|discussion|conclusions?|references|acknowledge?ments?|funding|competing interests|author contributions)\b"
METHOD_WORDS = r"(?i)\b(recruited|participants|genotyp(ed|ing)|cohort|informed consent|enrolled)\b"
AUTHOR_LIST = r"^[A-Z][\w.-]+ [A-Z][\w.-]+(, [A-Z][\w.-]+ [A-Z][\w.-]+){4,}$"


def method_sections(sections: DataFrame, key: str) -> DataFrame:
    """Rows (key, pos, title, text, ..) that hold a document's methods, with ``priority``.

    1: from a heading of methods up to the next heading of another part. 2, for documents without such a
    heading: sections that speak of methods. 3, for those without either: the body but for other parts.
    Lists of authors are no text.
    """
    title = F.coalesce("title", F.lit(""))
    own = sections.where(~F.coalesce(F.col("text").rlike(AUTHOR_LIST), F.lit(False)))
    start, stop = title.rlike(METHOD_HEADING), title.rlike(STOP_HEADING) & ~title.rlike(METHOD_HEADING)
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    own = own.withColumns({"_started": F.max(F.when(start, F.col("pos"))).over(so_far), "_stopped": F.max(F.when(stop, F.col("pos"))).over(so_far)})
    own = own.withColumn("_speaks", ~stop & F.coalesce(F.col("text").rlike(METHOD_WORDS), F.lit(False))).withColumn("_other", stop)
    own = own.withColumns({"_headed": F.max(F.col("_started").isNotNull()).over(whole), "_spoken": F.max("_speaks").over(whole)})
    own = own.withColumn("priority", F.when(F.col("_headed"), 1).when(F.col("_spoken"), 2).otherwise(3))
    inside = F.col("_started").isNotNull() & (F.col("_stopped").isNull() | (F.col("_started") > F.col("_stopped")))
    keep = F.when(F.col("_headed"), inside).when(F.col("_spoken"), F.col("_speaks")).otherwise(~F.col("_other"))
    return own.where(keep).drop("_started", "_stopped", "_speaks", "_other", "_headed", "_spoken")


def splitter_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """side, keys, pos, sentence, before, after: sentences that only one of two splitters gives, with their neighbours."""
    order = Window.partitionBy(*keys).orderBy("pos")

    def only(one, other, side):
        sided = one.withColumns({"before": F.lag("sentence").over(order), "after": F.lead("sentence").over(order)})
        return sided.join(other.select(*keys, "sentence").distinct(), [*keys, "sentence"], "left_anti").select(F.lit(side).alias("side"), *keys, "pos", "sentence", "before", "after")

    return only(a, b, "a").unionByName(only(b, a, "b"))


def dictionary_match(texts: DataFrame, names: DataFrame, abbreviations: DataFrame, key: str, text: str) -> DataFrame:
    """key, terms: full names in any case and abbreviations in theirs, unique, sorted and joined by ``|``."""
    found = contains_terms(texts, names, key, text).unionAll(contains_terms(texts, abbreviations, key, text, ignore_case=False))
    return found.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("term")), "|").alias("terms"))


MASK = "\u241f"


def mask(c: Column, terms: Sequence[str]) -> Column:
    """Every term, the longest first and in any case, as one mark that no other term matches."""
    longest = sorted(terms, key=lambda x: (-len(x), x))
    return F.regexp_replace(c, "(?i)(" + "|".join(re.escape(x) for x in longest) + ")", MASK)


# How numbers of people are written.
PEOPLE = ["participants", "individuals", "adolescents", "neonates", "patients", "children", "subjects", "controls", "families", "siblings", "infants", "proband", "samples", "adults", "female", "donors", "cases", "women", "trios", "twins", "pairs", "male", "men"]
SIZES = ["n_total", "Neffective", "Ncontrol", "Ncase", "ncase", "Neff", "N", "n"]
NUMERIC = rf"\b(?:{'|'.join(SIZES)})\s*=\s*[0-9][0-9,]*|\b[0-9][0-9,]*\s+(?:{'|'.join(PEOPLE)})\b"


def numeric_mentions(df: DataFrame, keys: list[str], text: str, least: int = 10) -> DataFrame:
    """keys, start, end, surface, n: numbers of people in a text, but for those up to ``least``."""
    own = df.select(*keys, text, F.explode(locate_all(F.col(text), NUMERIC)).alias("x"))
    surface = F.substring(F.col(text), F.col("x.start") + 1, F.col("x.end") - F.col("x.start"))
    own = own.select(*keys, F.col("x.start").alias("start"), F.col("x.end").alias("end"), surface.alias("surface"))
    number = F.replace(F.regexp_extract("surface", "[0-9][0-9,]*", 0), F.lit(","), F.lit("")).try_cast("long")
    return own.withColumn("n", number).where(F.col("n") > least)


def regroup(spans: DataFrame, key: str) -> DataFrame:
    """key, label: a document's spans (start, end, tag) as one sorted list."""
    return spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "tag"))).alias("label"))


def detect_format(c: Column) -> Column:
    """jats, tei, bioc or unknown: by the name of the root element, else by what stands inside."""
    root = F.regexp_extract(c, r"^(?s)\s*(?:<[?!][^>]*>\s*)*<(?:[A-Za-z_][\w.-]*:)?([A-Za-z_][\w.-]*)", 1)
    named = F.when(root == "TEI", "tei").when(root == "collection", "bioc").when(root == "article", "jats")
    inside = F.when(c.contains("http://www.tei-c.org/ns/1.0"), "tei").when(c.rlike(r"<passage[\s>/]"), "bioc").when(c.rlike(r"<(?:[A-Za-z_][\w.-]*:)?sec[\s>/]"), "jats")
    return F.when(c.isNotNull(), F.coalesce(named, inside, F.lit("unknown")))
