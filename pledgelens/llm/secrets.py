"""Secret scans over a trigram index, all in Spark SQL.

From each rule's regular expression a Boolean trigram query is derived: a conjunction of clauses, each a choice of
sets of trigrams of which one must be there whole. The index has a posting (trigram, document) for every trigram
that some query names, over the lower-case texts. Postings are joined with the queries' trigrams (a fixed table of
a few dozen rows), and intersected and united by counting; the documents that satisfy a rule's query are verified
with its expression. Rules without a mandatory trigram scan every document.

Spans are code-point offsets with an exclusive end. They come from cutting a text at the matches: the lengths of
the pieces and of the matches in between give the places, without a function per match. So a rule reads a candidate
twice, and a text is tested once for each of the few dozen trigrams that the index holds.

Edge cases: a null or empty text has no span; rows with equal id and text share postings, and each gets its spans;
null ids are matched with null ids; an empty table gives an empty table; all other columns stay, whatever their
names, but a column named `spans` is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pledgelens.llm.common import clean_text
from pledgelens.llm.native import free_names, quoted, starts_sql

try:
    from re import _constants as sre
    from re import _parser as sre_parser
except ImportError:  # Python before 3.11
    import sre_constants as sre
    import sre_parse as sre_parser


@dataclass(frozen=True)
class Rule:
    """pattern: the expression, alike in Python and Java, without repeated groups that could overflow a stack; value: the group
    that must have `least` characters; kept: SQL of the length that counts of a match `m`, all of it if empty."""

    kind: str
    pattern: str
    value: int = 0
    least: int = 1
    kept: str = ""


VALUE = "[A-Za-z0-9+/_.=-]"
KEYWORD = "(?i:(password|passwd|secret|token|api_?key))"
PEM_HEAD, PEM_LINE = "-----BEGIN [A-Z ]*PRIVATE KEY-----", "[A-Za-z0-9+/]{40,}"
#: To the key's end line, which single dashes may precede (headers of encrypted keys); without one over all that a key can hold.
PEM = PEM_HEAD + r"(?:[^-]*(?:-[^-]+){0,64}-----END [A-Z ]*PRIVATE KEY-----|[A-Za-z0-9+/=\x20\t\r\n]*)"


def _pem_length() -> str:
    """Without an end line: the head and the whole base64 lines behind it, and of the next line what is base64 and padding."""
    blank = r"[\x20\t\r]*$"
    whole = f"CASE WHEN i = 0 THEN x RLIKE {quoted('KEY-----' + blank)} ELSE x RLIKE {quoted('^' + PEM_LINE + blank)} END"
    bare = lambda x: f"length(regexp_replace({x}, {quoted('[\\x20\\t\\r]+$')}, ''))"
    size = "aggregate(slice(f.l, 1, n), 0L, (a, x) -> a + length(x) + 1)"
    tail = f"regexp_extract(try_element_at(f.l, n + 1), {quoted('^(?:' + PEM_LINE + '={0,2}|[A-Za-z0-9+/]+={1,2})')}, 0)"
    # n lines are whole; the last of them counts without its line break and blanks
    up_to = f"{size} - 1 - length(f.l[n - 1]) + {bare('f.l[n - 1]')}"
    length = f"CASE WHEN n = 0 THEN length(regexp_extract(m, {quoted('^' + PEM_HEAD)}, 0)) WHEN coalesce({tail}, '') <> '' THEN {size} + length({tail}) ELSE {up_to} END"
    count = "CASE WHEN array_position(f.whole, false) = 0 THEN size(f.l) ELSE cast(array_position(f.whole, false) AS int) - 1 END"
    lines = "transform(array(split(m, '\\n', -1)), l -> named_struct('l', l, 'whole', transform(l, (x, i) -> " + whole + ")))"
    return f"CASE WHEN contains(m, '-----END ') THEN length(m) ELSE transform({lines}, f -> transform(array({count}), n -> {length})[0])[0] END"


#: The base rules first, then common public key formats.
RULES = [
    Rule("assign", KEYWORD + r"""["']?\x20*[:=]\x20*["']?(""" + VALUE + "+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]{24,}", 0, 24),
    Rule("private_key", PEM, kept=_pem_length()),
    Rule("code_host", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_bot", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", "AIza[A-Za-z0-9_-]{35}"),
    # a run that no further parts follow matches too, so that it is read once, and falls by its empty group
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}(\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})?", 1, 1),
]
BASE = [r.kind for r in RULES[:3]]

Query = list[list[frozenset[str]]]


def trigram_query(pattern: str, most: int = 48) -> Query:
    """Clauses that every match satisfies, each a choice of trigram sets; empty if nothing is mandatory. Lower case."""

    def clause(texts: set[str]) -> Query:
        if any(len(t) < 3 for t in texts):
            return []
        sets = {frozenset(t[i : i + 3] for i in range(len(t) - 2)) for t in texts}
        return [sorted((x for x in sets if not any(y < x for y in sets)), key=sorted)]  # a larger set implies the smaller

    def choices(items) -> set[str] | None:
        out = set()
        for op, arg in items:
            if op is sre.LITERAL:
                out.add(chr(arg).lower())
            elif op is sre.RANGE and arg[1] - arg[0] < 8:
                out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None

    def walk(items, texts: set[str]) -> tuple[set[str], Query]:
        """texts: what may stand right before; returned with what is mandatory beyond it."""
        need: Query = []
        for op, arg in items:
            more: set[str] | None = None
            if op is sre.LITERAL:
                more = {chr(arg).lower()}
            elif op is sre.IN:
                more = choices(arg)
            elif op is sre.SUBPATTERN:
                inner, inside = walk(arg[3], {""})
                if not inside:
                    more = inner
                else:
                    need += inside
            elif op is sre.BRANCH:
                parts = [walk(x, {""}) for x in arg[1]]
                if not any(q for _, q in parts):
                    more = set().union(*(t for t, _ in parts))
            elif op is sre.MAX_REPEAT and arg[1] <= 4 or op is sre.MAX_REPEAT and arg[0] == arg[1] <= 8:
                inner, inside = walk(arg[2], {""})
                if not inside and inner:
                    more, power = set(), {""}
                    for k in range(arg[1] + 1):
                        more |= power if k >= arg[0] else set()
                        power = {a + b for a in power for b in inner}
                        if len(power) > most:
                            more = None
                            break
            elif op in (sre.AT,):
                continue
            joined = None if more is None else {a + b for a in texts for b in more}
            if joined is None or len(joined) > most or "" in (more or ()) and len(more) == 1:
                need += clause(texts)
                texts = more if more and len(more) <= most and op is not sre.AT else {""}
                if more is None:
                    texts = {""}
            else:
                texts = joined
        return texts, need

    texts, need = walk(sre_parser.parse(pattern), {""})
    return need + clause(texts)


def trigram_postings(docs: DataFrame, trigrams: list[str], key: list[str], text_col: str) -> DataFrame:
    """(key columns, trigram) for every listed trigram in a text."""
    low = F.array(F.lower(F.col(text_col)))  # bound once
    held = F.transform(low, lambda t: F.filter(F.array(*map(F.lit, trigrams)), lambda g: F.contains(t, g)))[0]
    return docs.select(*key, F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: list[Rule], key: list[str], text_col: str) -> DataFrame | None:
    """Key columns and the array of kinds whose query a document satisfies."""
    found = {r.kind: trigram_query(r.pattern) for r in rules}
    need = [(kind, c, a, len(found[kind]), len(grams), t) for kind, q in found.items() for c, options in enumerate(q) for a, grams in enumerate(options) for t in sorted(grams)]
    if not need:
        return None
    values = ", ".join(f"({quoted(kind)}, {c}, {a}, {n}, {grams}, {quoted(t)})" for kind, c, a, n, grams, t in need)
    queries = docs.sparkSession.sql(f"SELECT * FROM VALUES {values} AS q(kind, clause, choice, clauses, grams, trigram)")
    postings = trigram_postings(docs, sorted({x[-1] for x in need}), key, text_col).distinct()
    return (
        postings.join(F.broadcast(queries), "trigram")
        .groupBy(*key, "kind", "clause", "choice", "clauses", "grams")
        .agg(F.count("*").alias("n"))
        .where("n = grams")
        .groupBy(*key, "kind", "clauses")
        .agg(F.count_distinct("clause").alias("n"))
        .where("n = clauses")
        .groupBy(*key)
        .agg(F.collect_set("kind").alias("kinds"))
    )


def _spans_sql(rule: Rule, text: str, kinds: str) -> str:
    """Array of struct(start, end) of the rule's matches in the texts that are candidates for it."""
    p = quoted(rule.pattern)
    value = f"regexp_extract(z.m, {p}, {rule.value})" if rule.value else "z.m"  # a match holds its own groups
    cut = f"transform(array(regexp_extract_all({text}, {p}, 0)), m -> CASE WHEN size(m) > 0 THEN zip_with(m, slice(split({text}, {p}, -1), 1, size(m)), (x, y) -> named_struct('m', x, 'g', y)) END)[0]"
    lengths = "transform(c, z -> cast(length(z.g) + length(z.m) AS bigint))"
    starts = f"transform(array({lengths}), l -> {starts_sql('l')})[0]"
    places = f"transform(array({cut}), c -> zip_with(c, {starts}, (x, y) -> named_struct('m', x.m, 'start', y + length(x.g))))[0]"
    kept = f"transform(array(z.m), m -> {rule.kept})[0]" if rule.kept else "length(z.m)"
    spans = f"transform(filter({places}, z -> length({value}) >= {rule.least}), z -> named_struct('start', z.start, 'end', z.start + {kept}))"
    return spans if not trigram_query(rule.pattern) else f"CASE WHEN array_contains({kinds}, '{rule.kind}') THEN {spans} END"


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """Add spans: array of (start, rank, end, kind) in the order of start, then of the rules."""
    docs = docs.drop("spans")
    key, body, digest, kinds = free_names(docs, "_key", "_body", "_hash", "_kinds")
    rows = docs.withColumn(key, F.col(id_col)).withColumn(body, clean_text(text_col)).withColumn(digest, F.xxhash64(body))
    found = candidates(rows, rules, [key, digest], body)
    if found is None:
        rows = rows.withColumn(kinds, F.array().cast("array<string>"))
    else:
        found = found.select(F.col(key).alias("k"), F.col(digest).alias("h"), F.col("kinds").alias(kinds))
        rows = rows.join(found, rows[key].eqNullSafe(found.k) & (rows[digest] == found.h), "left").drop(found.k, found.h)
    none = "cast(array() AS array<struct<start: bigint, end: bigint>>)"
    parts = ", ".join(f"transform(coalesce({_spans_sql(r, body, kinds)}, {none}), s -> named_struct('start', s.start, 'rank', {k}, 'end', s.end, 'kind', '{r.kind}'))" for k, r in enumerate(rules))
    return rows.withColumn("spans", F.expr(f"array_sort(concat({parts}))")).select(*docs.columns, "spans")


def spans_text(spans: str | Column, kinds: list[str] | None = None) -> Column:
    """kind:start:end of the spans, joined by commas."""
    c = F.col(spans) if isinstance(spans, str) else spans
    if kinds is not None:
        c = F.filter(c, lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


#: What an assignment keeps before its value.
KEPT = KEYWORD + r"""["']?\x20*[:=]\x20*["']?"""


def redact(rows: DataFrame, *, text_col: str = "text", spans_col: str = "spans", mark: str = "<secret>") -> DataFrame:
    """Replace the spans of each text by a mark; an assignment keeps its keyword, spans that touch one another share a mark.

    The text is cut at the spans, in their order; a text of n characters with m spans costs about n * m steps.
    """
    t, s = f"coalesce(`{text_col}`, '')", f"`{spans_col}`"
    cut = f"substring({t}, cast(s.at + 1 AS int), cast(x.start - s.at AS int))"
    kept = f"CASE WHEN x.kind = {quoted(RULES[0].kind)} THEN regexp_extract(substring({t}, cast(x.start + 1 AS int), cast(x.end - x.start AS int)), {quoted('^' + KEPT)}, 0) ELSE '' END"
    step = f"CASE WHEN x.start >= s.at THEN named_struct('at', x.end, 'out', concat(s.out, array({cut}, {kept}, {quoted(mark)}))) ELSE named_struct('at', greatest(s.at, x.end), 'out', s.out) END"
    text = f"aggregate({s}, named_struct('at', 0L, 'out', cast(array() AS array<string>)), (s, x) -> {step}, s -> concat(array_join(s.out, ''), substring({t}, cast(s.at + 1 AS int))))"
    return rows.withColumn(text_col, F.expr(f"CASE WHEN size({s}) > 0 THEN {text} ELSE `{text_col}` END"))
