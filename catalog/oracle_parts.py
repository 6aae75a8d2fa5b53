"""The stages of a scan in DuckDB SQL, written apart from the Spark plans.

RE2 has no look-around, so the excluded SSN numbers are filtered after the match;
overlap removal folds a list per text; masking joins the pieces between matches.
"""

from __future__ import annotations

from catalog.inputs import TEXTS_SQL
from veilwork.constants import (
    BOOSTERS,
    CONFIDENCE,
    IBAN_LENGTHS,
    IGNORE_CASE_TYPES,
    LABEL_PATTERN,
    PATTERNS,
    REDUCERS,
    REGEX_TYPES,
)


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _pattern(kind: str) -> str:
    if kind == "SSN":
        return r"\b\d{3}-\d{2}-\d{4}\b"
    return ("(?i)" if kind in IGNORE_CASE_TYPES else "") + PATTERNS[kind]


def luhn(text: str) -> str:
    d = f"regexp_replace({text}, '[^0-9]', '', 'g')"
    digit = f"CAST(substr({d}, length({d}) - i, 1) AS INTEGER)"
    return f"""(list_sum([CASE WHEN i % 2 = 0 THEN {digit}
        WHEN {digit} > 4 THEN {digit} * 2 - 9 ELSE {digit} * 2 END
        for i in range(length({d}))]) % 10 = 0)"""


def iban_ok(text: str) -> str:
    compact = f"replace({text}, ' ', '')"
    cases = " ".join(
        f"WHEN {q(c)} THEN length({compact}) = {n}" for c, n in IBAN_LENGTHS.items()
    )
    return f"(CASE substr({compact}, 1, 2) {cases} ELSE true END)"


def _confidence(kind: str) -> str:
    if kind == "CREDIT_CARD":
        return f"CASE WHEN {luhn('hit')} THEN 0.9 ELSE 0.27 END"
    if kind == "IBAN":
        return f"CASE WHEN {iban_ok('hit')} THEN 0.88 ELSE 0.352 END"
    return str(CONFIDENCE[kind])


def raw_of(kind: str, texts: str = "texts") -> str:
    """All matches of one type with their offsets."""
    p = q(_pattern(kind))
    keep = ""
    if kind == "SSN":
        keep = """WHERE substr(hit, 1, 3) NOT IN ('000', '666') AND substr(hit, 1, 1) <> '9'
            AND substr(hit, 5, 2) <> '00' AND substr(hit, 8, 4) <> '0000'"""
    return f"""SELECT doc_id, {q(kind)} AS entity_type, {REGEX_TYPES.index(kind) + 1} AS ord,
            n, CAST(b AS INTEGER) AS start, CAST(b + length(hit) AS INTEGER) AS "end", hit AS text,
            CAST({_confidence(kind)} AS DOUBLE) AS confidence
        FROM (SELECT doc_id, n, m[n] AS hit,
                list_sum([length(x) for x in g[1:n]])
                    + coalesce(list_sum([length(x) for x in m[1:n - 1]]), 0) AS b
            FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS n
                FROM (SELECT doc_id, regexp_extract_all(text, {p}) AS m,
                        string_split_regex(text, {p}) AS g FROM {texts})))
        {keep}"""


def raw_all(types: tuple[str, ...] = REGEX_TYPES) -> str:
    return "\nUNION ALL\n".join(raw_of(kind) for kind in types)


def survivors(rows: str) -> str:
    """Greedy overlap removal over all fields of ``rows``."""
    fields = ["entity_type", "ord", "start", "end", "text", "confidence", "context", "engine"]
    packed = ", ".join(f"'{f}': {f'r.{chr(34)}{f}{chr(34)}'}" for f in fields)
    back = ", ".join(f'd."{f}" AS "{f}"' for f in fields)
    return f"""SELECT doc_id, {back} FROM (
        SELECT doc_id, unnest(list_reduce(
            list([{{{packed}}}] ORDER BY confidence DESC, start, ord),
            lambda kept, x: CASE
                WHEN len(list_filter(kept, lambda k: x[1].start < k."end" AND x[1]."end" > k.start)) > 0
                THEN kept ELSE list_concat(kept, x) END)) AS d
        FROM {rows} r GROUP BY doc_id)"""


def window_of(text: str, start: str, end: str) -> str:
    return (
        f"substr({text}, greatest({start} - 80, 0) + 1,"
        f" {end} + 80 - greatest({start} - 80, 0))"
    )


def _words(words: dict[str, list[str]], context: str) -> str:
    cases = " ".join(
        f"WHEN {q(kind)} THEN {' OR '.join(f'contains({context}, {q(w)})' for w in each)}"
        for kind, each in words.items()
    )
    return f"(CASE entity_type {cases} ELSE false END)"


def context_columns(texts: str = "texts") -> str:
    """Detections with context, the three signals and the new confidence."""
    return f"""SELECT *, round(least(greatest(confidence + CASE WHEN boosted THEN 0.08 ELSE 0 END
            - CASE WHEN reduced THEN 0.15 ELSE 0 END
            + CASE WHEN labelled THEN 0.1 ELSE 0 END, 0), 1), 3) AS rescored
        FROM (SELECT *, {_words(BOOSTERS, "around")} AS boosted,
                {_words(REDUCERS, "around")} AS reduced,
                regexp_matches(around, {q("(?i)" + LABEL_PATTERN)}) AS labelled
            FROM (SELECT d.*, {window_of("t.text", "d.start", 'd."end"')} AS window_text,
                    {window_of("lower(t.text)", "d.start", 'd."end"')} AS around
                FROM first_pass d JOIN {texts} t USING (doc_id)))"""


def with_parts(
    final: str,
    texts: str = TEXTS_SQL,
    keep: str = "confidence >= 0.7",
    scanned: str = "true",
    ner: str | None = None,
    types: tuple[str, ...] = REGEX_TYPES,
    context: bool = True,
) -> str:
    """A statement whose ``final`` part can use the stages:

    texts, scanned_texts, raw, first_pass, scored, kept, final_pass.
    """
    engines = "SELECT * FROM regex_pass" + (
        f" UNION ALL SELECT doc_id, entity_type, ord, start, \"end\", text, confidence, '', 'nlp'"
        f" FROM ({ner})"
        if ner
        else ""
    )
    score = (
        f"""SELECT doc_id, entity_type, ord, start, "end", text, rescored AS confidence,
            window_text AS context, engine FROM ({context_columns("scanned_texts")})"""
        if context
        else "SELECT * FROM first_pass"
    )
    raw = " UNION ALL ".join(raw_of(kind, "scanned_texts") for kind in types)
    return f"""WITH texts AS MATERIALIZED ({texts}),
        scanned_texts AS MATERIALIZED (SELECT * FROM texts WHERE {scanned}),
        raw AS MATERIALIZED (SELECT *, '' AS context, 'regex' AS engine FROM ({raw})),
        regex_pass AS MATERIALIZED ({_typed(survivors("raw"))}),
        first_pass AS MATERIALIZED ({engines}),
        scored AS MATERIALIZED ({score}),
        kept AS MATERIALIZED (SELECT * FROM scored WHERE {keep}),
        final_pass AS MATERIALIZED ({_typed(survivors("kept"))})
        {final}"""


def _typed(rows: str) -> str:
    return f'SELECT doc_id, entity_type, ord, start, "end", text, confidence, context, engine FROM ({rows})'


def masked_texts(replacement: str, detections: str = "final_pass", joins: str = "") -> str:
    """(doc_id, source, masked_text): the pieces between detections, joined."""
    return f"""SELECT t.doc_id, t.source,
            CASE WHEN p.doc_id IS NULL THEN t.text
                ELSE p.front || substr(t.text, p.reach + 1) END AS masked_text
        FROM texts t LEFT JOIN (
            SELECT doc_id, string_agg(piece, '' ORDER BY start) AS front, max("end") AS reach
            FROM (SELECT d.doc_id, d.start, d."end",
                    substr(t.text, lag(d."end", 1, 0) OVER w + 1,
                        d.start - lag(d."end", 1, 0) OVER w) || {replacement} AS piece
                FROM {detections} d JOIN texts t USING (doc_id) {joins}
                WINDOW w AS (PARTITION BY d.doc_id ORDER BY d.start))
            GROUP BY doc_id) p ON p.doc_id = t.doc_id"""


REDACT = "'<' || d.entity_type || '_REDACTED>'"


def digits(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9]', '', 'g')"


def partial_generic(text: str) -> str:
    return (
        f"CASE WHEN length({text}) <= 4 THEN repeat('*', length({text}))"
        f" ELSE repeat('*', length({text}) - 4) || right({text}, 4) END"
    )


def partial_email(text: str) -> str:
    local, domain = f"split_part({text}, '@', 1)", f"split_part({text}, '@', 2)"
    return f"""CASE WHEN len(string_split({text}, '@')) <> 2 THEN repeat('*', length({text}))
        ELSE left({local}, 1) || repeat('*', length({local}) - 1) || '@' ||
            CASE WHEN contains({domain}, '.')
                THEN repeat('*', length(split_part({domain}, '.', 1))) || '.'
                    || split_part({domain}, '.', -1)
                ELSE repeat('*', length({domain})) END END"""


def partial_digits(text: str, condition: str, prefix: str) -> str:
    return f"""CASE WHEN length({digits(text)}) {condition}
        THEN {q(prefix)} || right({digits(text)}, 4) ELSE repeat('*', length({text})) END"""


PARTIAL = {
    "EMAIL": partial_email,
    "SSN": lambda t: partial_digits(t, "= 9", "***-**-"),
    "CREDIT_CARD": lambda t: partial_digits(t, ">= 12", "****-****-****-"),
    "PHONE_NUMBER": lambda t: partial_digits(t, ">= 7", "***-***-"),
}


def partial(kind: str, text: str) -> str:
    cases = " ".join(f"WHEN {q(k)} THEN {form(text)}" for k, form in PARTIAL.items())
    return f"(CASE {kind} {cases} ELSE {partial_generic(text)} END)"


def hashed(text: str, salt: str = "", algorithm: str = "sha256") -> str:
    function = "md5" if algorithm == "md5" else "sha256"
    return f"{q(algorithm.upper() + ':')} || left({function}({q(salt)} || {text}), 16)"
