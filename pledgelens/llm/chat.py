"""Chat formatting: schema fingerprints select declarative mappings to canonical turns; all in Spark SQL.

A record is a JSON text. Its fingerprint is a hash of its nested field paths: the schema of the parsed record with
the leaf types taken out, which holds every path once, in sorted order. A mapping names the layout it is for by an
example record and gives the canonical turns (role, text) as a SQL expression over `record`; all mappings stand in
one CASE over fingerprints, so a table of mixed layouts takes one pass. Turns are written with a template of
control strings, and control strings inside texts get a backslash after their first character (one more where
backslashes are there already), which `parse_chat` takes out again.

Texts of any length go through: the fingerprint of a long record is taken without its string values, and the limit on
strings is lifted to that of Spark's own strings (2**31 - 1 bytes for a record).

Edge cases: a null text or role is an empty one; a record that is null, is no JSON or has an unknown fingerprint
gets null turns, an empty formatted text and an empty mask; equal turn numbers are ordered by role, then text;
repeated rows are repeated turns; rows without a conversation id form one conversation; an empty table gives an
empty table; all other columns stay, whatever their names, but columns with the names of results are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pledgelens.llm.native import free_names, quoted, starts_sql


@dataclass(frozen=True)
class Mapping:
    name: str
    example: str
    turns: str


def _pair(*fields: tuple[str, str]) -> str:
    turns = ", ".join(f"named_struct('role', '{r}', 'text', coalesce(r.{f}, ''))" for r, f in fields)
    return f"array({turns})"


def _list(field: str, role: str, text: str) -> str:
    return f"transform(r.{field}, m -> named_struct('role', coalesce(m.`{role}`, ''), 'text', coalesce(m.`{text}`, '')))"


#: Fields that mappings may read, as a schema; records are parsed once, for all mappings.
FIELDS = {
    "messages": "ARRAY<STRUCT<role: STRING, content: STRING>>",
    "conversations": "ARRAY<STRUCT<`from`: STRING, `value`: STRING>>",
    **{f: "STRING" for f in ("prompt", "response", "completion", "question", "answer", "system", "instruction", "input", "output", "text")},
}


#: Layouts of public instruction, prompt and message sets.
MAPPINGS = [
    Mapping("messages", '{"messages": [{"role": "r", "content": "c"}]}', _list("messages", "role", "content")),
    Mapping("from_value", '{"conversations": [{"from": "r", "value": "c"}]}', _list("conversations", "from", "value")),
    Mapping("prompt_response", '{"prompt": "p", "response": "r"}', _pair(("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_completion", '{"prompt": "p", "completion": "r"}', _pair(("user", "prompt"), ("assistant", "completion"))),
    Mapping("question_answer", '{"question": "p", "answer": "r"}', _pair(("user", "question"), ("assistant", "answer"))),
    Mapping("system_prompt_response", '{"system": "s", "prompt": "p", "response": "r"}', _pair(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("instruction_output", '{"instruction": "p", "output": "r"}', _pair(("user", "instruction"), ("assistant", "output"))),
    Mapping(
        "instruction_input_output",
        '{"instruction": "p", "input": "i", "output": "r"}',
        "array(named_struct('role', 'user', 'text', concat_ws('\\n', r.instruction, nullif(r.input, ''))), named_struct('role', 'assistant', 'text', coalesce(r.output, '')))",
    ),
    Mapping("text", '{"text": "t"}', _pair(("user", "text"))),
]


LEAF_TYPES = "\\b(STRING|BIGINT|DOUBLE|BOOLEAN|VOID|VARIANT|DECIMAL\\([0-9, ]*\\))(?=[,>]|$)"


def skeleton_sql(record: str) -> str:
    """A JSON text without its string values: escaped backslashes and quotes go first, so a value ends at the next quote."""
    bare = f"replace(replace({record}, {quoted(chr(92) * 2)}, ''), {quoted(chr(92) + chr(34))}, '')"
    # keys stay, with two quotes behind their colons, all other strings become two quotes; then the keys' quotes go
    marked = f"regexp_replace({bare}, {quoted('(\"[^\"]*+\"\\s*+:\\s*+)|\"[^\"]*+\"')}, {quoted('$1\"\"')})"
    return f"regexp_replace({marked}, {quoted('(:\\s*+)\"\"')}, '$1')"


#: The parser's limit on a string; longer records are parsed without their values, which gives the same paths.
PARSED_BYTES = 20_000_000


def fingerprint_sql(record: str) -> str:
    """Hash of the nested field paths of a JSON text; null where it is none."""
    parsed = f"CASE WHEN octet_length({record}) < {PARSED_BYTES} THEN try_parse_json({record}) ELSE try_parse_json({skeleton_sql(record)}) END"
    paths = f"nullif(schema_of_variant({parsed}), 'VOID')"
    return f"transform(array({paths}), p -> CASE WHEN p IS NOT NULL THEN {_paths_hash_sql('p')} END)[0]"


def _paths_hash_sql(schema: str) -> str:
    return f"xxhash64(regexp_replace({schema}, {quoted(LEAF_TYPES)}, ''))"


def canonical_turns(records: DataFrame, *, record_col: str = "record", mappings: list[Mapping] = MAPPINGS, fields: dict[str, str] = FIELDS) -> DataFrame:
    """Add fingerprint, layout and turns (array of role and text). Mappings are expressions over `r`, the parsed record."""
    (parsed,) = free_names(records, "_parsed")
    json, broken = f"`{record_col}`", "_broken"
    schema = ", ".join(f"`{f}` {t}" for f, t in {**fields, broken: "STRING"}.items())
    got = records.withColumn("fingerprint", F.expr(fingerprint_sql(json)))
    got = got.withColumn(parsed, F.expr(f"from_json({json}, {quoted(schema)}, map('maxStringLen', '{2**31 - 1}', 'columnNameOfCorruptRecord', '{broken}'))"))
    # without a lambda, so that the examples' fingerprints are folded to constants
    layout = " ".join(f"WHEN {_paths_hash_sql(f'schema_of_variant(try_parse_json({quoted(m.example)}))')} THEN '{m.name}'" for m in mappings)
    got = got.withColumn("layout", F.expr(f"CASE WHEN {parsed}.{broken} IS NULL THEN CASE fingerprint {layout} END END"))
    turns = " ".join(f"WHEN '{m.name}' THEN {re.sub(r'\br\.', f'{parsed}.', m.turns)}" for m in mappings)
    return got.withColumn("turns", F.expr(f"CASE layout {turns} END")).drop(parsed)


#: The template's control strings, as (role, before, after); other roles are written out.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
ROLE_OPEN, ROLE_CLOSE, END = "[ROLE]", "[/ROLE]", "[END]"
TAILS = r"(INST\]|/INST\]|ROLE\]|/ROLE\]|END\]|s>|/s>|<SYS>>|</SYS>>)"


def escape_sql(text: str) -> str:
    return f"regexp_replace({text}, {quoted(r'(\[|<)(\\*)' + TAILS)}, {quoted('$1' + chr(92) * 2 + '$2$3')})"


def unescape_sql(text: str) -> str:
    return f"regexp_replace({text}, {quoted(r'(\[|<)\\(\\*)' + TAILS)}, '$1$2$3')"


def format_chat(rows: DataFrame, *, turns_col: str = "turns") -> DataFrame:
    """Add formatted (the templated text) and loss_mask (array of start and end, in code points, of the assistant's texts)."""
    before = "CASE t.role " + " ".join(f"WHEN '{r}' THEN '{a}'" for r, (a, _) in MARKS.items()) + f" ELSE concat('{ROLE_OPEN}', {escape_sql('t.role')}, '{ROLE_CLOSE}') END"
    after = "CASE t.role " + " ".join(f"WHEN '{r}' THEN '{b}'" for r, (_, b) in MARKS.items()) + f" ELSE '{END}' END"
    pieces, sizes, starts = free_names(rows, "_parts", "_sizes", "_starts")
    parts = rows.withColumn(pieces, F.expr(f"transform(coalesce({turns_col}, array()), t -> named_struct('own', t.role = 'assistant', 'before', {before}, 'body', {escape_sql('t.text')}, 'after', {after}))"))
    parts = parts.withColumn("formatted", F.expr(f"array_join(transform({pieces}, p -> concat(p.before, p.body, p.after)), '')"))
    parts = parts.withColumn(sizes, F.expr(f"transform({pieces}, p -> cast(length(p.before) + length(p.body) + length(p.after) AS bigint))"))
    parts = parts.withColumn(starts, F.expr(starts_sql(sizes)))
    begin = f"z.{starts} + length(z.{pieces}.before)"
    mask = f"transform(filter(arrays_zip({pieces}, {starts}), z -> z.{pieces}.own), z -> named_struct('start', {begin}, 'end', {begin} + length(z.{pieces}.body)))"
    return parts.withColumn("loss_mask", F.expr(mask)).drop(pieces, sizes, starts)


def parse_chat(rows: DataFrame, *, formatted_col: str = "formatted") -> DataFrame:
    """Add read_turns, the turns that a formatted text holds."""
    marked = "|".join(f"\\Q{a}\\E.*?\\Q{b}\\E" for a, b in MARKS.values())
    found = f"regexp_extract_all({formatted_col}, {quoted(f'(?s){marked}|\\Q{ROLE_OPEN}\\E.*?\\Q{END}\\E')}, 0)"
    cases = " ".join(f"WHEN startswith(x, '{a}') THEN named_struct('role', '{r}', 'text', {unescape_sql(f'substring(x, {len(a) + 1}, length(x) - {len(a) + len(b)})')})" for r, (a, b) in MARKS.items())
    role = f"substring(x, {len(ROLE_OPEN) + 1}, instr(x, '{ROLE_CLOSE}') - {len(ROLE_OPEN) + 1})"
    body = f"substring(x, instr(x, '{ROLE_CLOSE}') + {len(ROLE_CLOSE)}, length(x) - instr(x, '{ROLE_CLOSE}') - {len(ROLE_CLOSE) + len(END) - 1})"
    return rows.withColumn("read_turns", F.expr(f"transform({found}, x -> CASE {cases} ELSE named_struct('role', {unescape_sql(role)}, 'text', {unescape_sql(body)}) END)"))


def loss_text_sql(formatted: str = "formatted", mask: str = "loss_mask") -> str:
    """All text under the mask, control strings restored."""
    return f"array_join(transform({mask}, m -> {unescape_sql(f'substring({formatted}, cast(m.start + 1 AS int), cast(m.end - m.start AS int))')}), '')"


def gather_records(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One JSON record for each conversation of a table with a row for each turn.

    The layouts are dealt by what the turns allow and the conversation's number: a user's and an assistant's turn become
    one of five pair records (the one with an input where the user's text goes on after a line), the same after a system
    turn a prompt record with it, a user's turn alone a text, more than six turns a from/value list, all else messages.
    A conversation is one record, so it must fit in one task.
    """
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    (t,) = free_names(turns, "_turns")
    got = turns.groupBy(F.col(id_col).alias(id_col)).agg(F.sort_array(F.collect_list(row)).alias(t))
    kind, head = f"pmod(xxhash64(cast({id_col} AS string)), 4)" if dict(turns.dtypes)[id_col] == "string" else f"pmod({id_col}, 4)", f"instr({t}[0].text, '\n')"
    pair = lambda a, b: f"to_json(named_struct('{a}', {t}[0].text, '{b}', {t}[1].text))"
    return got.select(
        id_col,
        F.expr(f"""CASE
          WHEN transform({t}, t -> t.role) = array('user', 'assistant') THEN CASE
            WHEN {head} > 0 AND {head} < length({t}[0].text) THEN to_json(named_struct('instruction', left({t}[0].text, {head} - 1), 'input', substring({t}[0].text, {head} + 1), 'output', {t}[1].text))
            WHEN {kind} = 0 THEN {pair('prompt', 'response')} WHEN {kind} = 1 THEN {pair('prompt', 'completion')} WHEN {kind} = 2 THEN {pair('question', 'answer')} ELSE {pair('instruction', 'output')} END
          WHEN transform({t}, t -> t.role) = array('system', 'user', 'assistant') THEN to_json(named_struct('system', {t}[0].text, 'prompt', {t}[1].text, 'response', {t}[2].text))
          WHEN transform({t}, t -> t.role) = array('user') THEN to_json(named_struct('text', {t}[0].text))
          WHEN size({t}) > 6 THEN to_json(named_struct('conversations', transform({t}, t -> named_struct('from', t.role, 'value', t.text))))
          ELSE to_json(named_struct('messages', transform({t}, t -> named_struct('role', t.role, 'content', t.text)))) END""").alias("record"),
    )
