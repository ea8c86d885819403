"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text: at-signs, schemes, digits, plus signs before
digits, and cues that name an identifier. From each anchor a local parser for its kind reads to the
left and right as far as its grammar allows and validates what it read (octets, Luhn, mod 97, digit
counts). Matches of a kind don't overlap; the leftmost wins; one that fails validation is dropped
and not tried again shorter.

Offsets are code points, ends are exclusive. A null or empty text has no span. Repeated rows each
get their row, and an empty table gives none. Texts are read whole; an anchor costs time in proportion to what it
expands to. Columns other than doc_id and text, whatever their names, are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: The base kinds, then those that schemes and cues add.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "account", "secret")

LOCAL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DIGITS = "0123456789"
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
ACCOUNT_CUES = ("account", "acct", "customer", "passport", "ssn", "license no")
IBAN_CUES = ("iban",)
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT_RUN = re.compile(r"[0-9]+")
URL_REST = r"[^\x00-\x20<>\"'|]+"
URL_TAIL = ".,;:!?)"
#: What follows a cue: a part before the identifier, the identifier, and (after it) what ends it.
IBAN_PARTS = (r"[ :=#\"]{0,4}", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}", r"[^A-Za-z0-9]")
ACCOUNT_PARTS = (r"(?: (?:no|number|id))?[ .:=#\"]{1,4}", r"[A-Z]{0,3}[0-9][0-9-]{4,18}[0-9]", r"[^A-Za-z0-9]")
SECRET_PARTS = (r"[ ]{0,2}[:=][ ]{0,2}[\"']?", r"[A-Za-z0-9_+/=-]{16,}", r"")
_URL_REST = re.compile(URL_REST)
_IBAN, _ACCOUNT, _SECRET = (re.compile(f"{before}({own})" + (f"(?={end}|$)" if end else "")) for before, own, end in (IBAN_PARTS, ACCOUNT_PARTS, SECRET_PARTS))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def forms(word: str) -> list[str]:
    """The spellings of an anchor that are looked for."""
    return sorted({word, word.title(), word.upper()})


@lru_cache(1)
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("at", 1))
    for d in DIGITS:
        found.add_word(d, ("digit", 1))
        found.add_word(f"+{d}", ("plus", 2))
    for kind, words in (("url", SCHEMES), ("iban", IBAN_CUES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for word in words:
            for form in forms(word):
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of one text, by kind as listed and then by start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email = ip = card = phone = last_at = 0  # where each kind may start next
    others = dict.fromkeys(("url", "iban", "account", "secret"), 0)
    for last, (kind, width) in anchors().iter(text) if text else ():
        at = last - width + 1
        if kind == "digit":
            if at >= ip:
                if m := _IP.match(text, at):
                    ip = m.end()
                    if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
                        out["ip"].append(m.span())
                else:
                    ip = _DIGIT_RUN.match(text, at).end()
            if at >= card:
                if m := _CARD.match(text, at):
                    card = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        out["card"].append(m.span())
                else:
                    card = at + 1
        elif kind == "plus":
            if at >= phone and (m := _PHONE.match(text, at)):
                phone = m.end()
                if 9 <= sum(c in DIGITS for c in m[0]) <= 15:
                    out["phone"].append(m.span())
        elif kind == "at":
            low = max(email, last_at)
            start = low + len(text[low:at].rstrip(LOCAL_CHARS))
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email = m.end()
                out["email"].append((start, email))
            last_at = at + 1
        elif at >= others[kind]:
            end = last + 1
            if kind == "url":
                if m := _URL_REST.match(text, end):
                    others[kind] = m.end()
                    out["url"].append((at, end + len(m[0].rstrip(URL_TAIL))))
                continue
            m = (_IBAN if kind == "iban" else _ACCOUNT if kind == "account" else _SECRET).match(text, end)
            if m:
                others[kind] = m.end(1)
                if kind != "iban" or mod97(m[1].replace(" ", "")):
                    out[kind].append(m.span(1))
    return [(k, s, e) for k in KINDS for s, e in out[k]]


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, spans (array of kind, start, end) for every row."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in spans(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, of)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame) -> DataFrame:
    """doc_id, text with every span replaced by its kind in brackets; of spans that overlap, the
    first, and of those the longest, stands for all it covers."""

    def hide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column(1).to_pylist():
                parts, at = [], 0
                for kind, start, end in sorted(spans(text), key=lambda x: (x[1], -x[2])):
                    if start >= at:
                        parts += [text[at:start], f"[{kind}]"]
                    at = max(at, end)
                texts.append(text if not parts else "".join(parts) + text[at:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(hide, "doc_id long, text string")


def _joined(found, base: bool):
    if base:
        found = F.filter(found, lambda s: s["kind"].isin(*BASE_KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(docs: DataFrame) -> DataFrame:
    """op4: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = find_spans(docs)
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) AS long)").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("spans"), True).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans"), False).alias("spans"))


def brute_force(text: str | None) -> str:
    """The base spans of a text by plain pattern search, joined; for tests."""
    text, out = text or "", []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def _either(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(re.escape(f) for w in words for f in forms(w)) + ")"


def _kind_sql(kind: str, number: int, pattern: str, span: str, valid: str) -> str:
    """Spans of one kind: what the pattern matches from the left, with the places from what lies between."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, {number} AS place, s + b AS b, s + e AS e FROM (
      SELECT doc_id, m, s, {span} FROM (
        SELECT doc_id, ms[i] AS m, list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
        FROM (SELECT doc_id, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{quoted}') AS ms, string_split_regex(t, '{quoted}') AS ps FROM t))) WHERE {valid})"""


def _cue_sql(kind: str, number: int, cues: tuple[str, ...], parts: tuple[str, str, str], valid: str = "true") -> str:
    before, own, end = parts
    pattern = f"{_either(cues)}{before}({own})({end + '|$' if end else ''})"
    quoted = pattern.replace("'", "''")
    one, two = (f"length(regexp_extract(m, '{quoted}', {g}))" for g in (1, 2))
    return _kind_sql(kind, number, pattern, f"length(m) - {two} - {one} AS b, length(m) - {two} AS e", valid.replace("{own}", f"replace(regexp_extract(m, '{quoted}', 1), ' ', '')"))


def _sql() -> str:
    whole = "0 AS b, length(m) AS e"
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    doubled = "(CAST(substr(x, length(x) - i, 1) AS BIGINT) * 2)"
    luhn_sql = f"list_sum(list_transform(range(0, length(x)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(x, length(x) - i, 1) AS BIGINT) ELSE {doubled} // 10 + {doubled} % 10 END)) % 10 = 0".replace("x,", f"{digits},").replace("length(x)", f"length({digits})")
    turned = "substr({own}, 5) || substr({own}, 1, 4)"
    letters = "instr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', c)"
    mod_sql = f"list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split({turned}, ''), lambda c: CASE WHEN {letters} > 0 THEN CAST({letters} + 9 AS BIGINT) ELSE CAST(c AS BIGINT) END)), lambda a, c: (CASE WHEN c > 9 THEN a * 100 ELSE a * 10 END + c) % 97) = 1"
    scheme = _either(SCHEMES).replace("'", "''")
    kinds = [
        _kind_sql("email", 1, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", whole, "true"),
        _kind_sql("ip", 2, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", whole, "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) < 4 AND CAST('0' || right(x, 3) AS BIGINT) <= 255)) = 4"),
        _kind_sql("card", 3, r"[0-9]([\x20-]?[0-9])+", whole, f"length({digits}) BETWEEN 13 AND 19 AND {luhn_sql}"),
        _kind_sql("phone", 4, r"\+[0-9][\x20().0-9-]+[0-9]", whole, f"length({digits}) BETWEEN 9 AND 15"),
        _kind_sql("url", 5, _either(SCHEMES) + URL_REST, f"0 AS b, greatest(length(rtrim(m, '{URL_TAIL}')), length(regexp_extract(m, '^{scheme}'))) AS e", "true"),
        _cue_sql("iban", 6, IBAN_CUES, IBAN_PARTS, mod_sql),
        _cue_sql("account", 7, ACCOUNT_CUES, ACCOUNT_PARTS),
        _cue_sql("secret", 8, SECRET_CUES, SECRET_PARTS),
    ]
    joined = "coalesce(string_agg(kind || ':' || CAST(b AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY place, b)"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE_KINDS)
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({" UNION ALL ".join(kinds)})
SELECT t.doc_id, {counts}, sha256({joined} FILTER (WHERE place <= {len(BASE_KINDS)}), '')) AS base_sha256, {joined} FILTER (WHERE kind IS NOT NULL), '') AS spans
FROM t LEFT JOIN f ON t.doc_id = f.doc_id GROUP BY t.doc_id"""


SQL = _sql()
