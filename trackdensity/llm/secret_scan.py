"""Secrets in texts: fixed patterns, and literals that end up under a sensitive name.

Base spans are matches of three patterns (see PATTERNS), leftmost and non-overlapping for each
kind; matches whose part of interest is too short are dropped after matching.

The lexer reads each text once for assignments in source and configuration syntax:
    name = "literal"     name: literal      "name": "literal"     export NAME=literal
    obj.name := `literal`     table["name"] => 'literal'     <name>literal</name>     --name literal
The right side is a sequence of quoted literals, bare words and names joined by + or . or by
nothing; ${NAME}, $NAME and %NAME% inside literals are names too. A table of constants holds, for
each name read so far, its value and the literals it came from, so a secret put together from
constants, or renamed on its way, is found where it was written. The last assignment wins.

A literal is reported (kind `literal`: the places within its quotes) when the name it ends up
under is sensitive (words of the name, each with a weight) and the whole value looks like a secret
(length, kinds of characters, entropy; placeholders and plain words do not): their product is at
least `threshold`. Literals inside a base span of kind assign are not reported again.

Positions are code points, ends exclusive. Time and memory grow with the length of a text.

Defined cases: null counts as empty; a text without matches has zeros, the digest of no bytes and
'' as its spans; ids may be null or repeat, each row is scanned by itself; an empty table gives an
empty table; other columns are not read by digest(), and kept by scan() and redact().
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.names import free

# The base patterns, and how long the match (or its group 2) must be.
PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    # a run of hex digits is matched as a whole, so runs that are too short need no match
    "hex": (re.compile(r"[0-9a-f]{16,}"), 0, 16),
}
KINDS = [*PATTERNS, "literal"]

# Words of a name and how strongly each makes its value a secret.
WORDS = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "pass": 0.9, "passphrase": 1.0, "secret": 1.0, "secrets": 1.0, "token": 1.0, "tokens": 0.8, "credential": 1.0, "credentials": 1.0, "apikey": 1.0,
    "auth": 0.8, "authorization": 0.9, "bearer": 0.9, "jwt": 0.9, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "pin": 0.6, "dsn": 0.7, "webhook": 0.7, "salt": 0.6, "signature": 0.6, "cookie": 0.6,
}
KEY_BEFORE = {"api", "private", "access", "secret", "signing", "encryption", "master", "session", "client", "service", "account", "auth", "deploy", "license", "ssh", "shared", "storage"}
HARMLESS = {"file", "path", "name", "length", "type", "count", "url", "uri", "field", "header", "prefix", "regex", "pattern", "hint", "label", "expiry", "ttl", "policy", "id", "size", "min", "max"}
PLACEHOLDERS = re.compile(r"(?:change|replace)[-_ ]?me|example|placeholder|your[-_ ]|xxx|\*\*\*|dummy|redacted|<[^>]*>|none|null|undefined|true|false|todo", re.IGNORECASE)
URL_PASSWORD = re.compile(r"[a-z][a-z0-9+.-]*://[^\s/:@]*:([^\s/@]+)@")

LEAST, MOST = 8, 4096  # lengths of a value that may be a secret; longer values are constants of no interest
PARTS = 64  # literals that one value is put together from

NAME_CHAR = re.compile(r"[\w$.-]", re.ASCII)
PARTS_OF_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
OPERATOR = re.compile(r":=|=>|[:=](?!=)|<(?=[A-Za-z])|(?<![\w-])--(?=[a-z])")
STRING = re.compile(r"""[rRbBuUfF]{0,2}(?:\"\"\"((?:[^"\\]|\\.|"(?!""))*)\"\"\"|"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`((?:[^`\\]|\\.)*)`)""", re.DOTALL)
BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>+#]+""")
REFERENCE = re.compile(r"\$\{(\w+)\}|\$(\w+)|%(\w+)%|\{(\w+)\}", re.ASCII)
IDENTIFIER = re.compile(r"[$@]?[A-Za-z_][\w.]*\Z", re.ASCII)
JOIN = re.compile(r"[^\S\n]*(?:\+|\.\.?|\\\n)?\s*(?=[\"'`])|[^\S\n]*(?:\+|\.\.)\s*")
TAG = re.compile(r"<([A-Za-z][\w.-]*)>([^<>]+)</", re.ASCII)
FLAG = re.compile(r"--([a-z][\w-]*)[ =]", re.ASCII)


def name_weight(name: str) -> float:
    """How sensitive a target's name is, 0 to 1: its heaviest word, less for words like _file or _length at its end."""
    words = [w.lower() for w in PARTS_OF_NAME.findall(name)]
    if not words:
        return 0.0
    weight = max(WORDS.get(w, 0.0) for w in words)
    weight = max([weight, *(1.0 for a, b in zip(words, words[1:], strict=False) if b in ("key", "keys") and a in KEY_BEFORE), *(1.0 for a, b in zip(words, words[1:], strict=False) if a + b in WORDS)])
    return weight * (0.3 if words[-1] in HARMLESS and len(words) > 1 else 1.0)


def value_weight(value: str) -> float:
    """How much a value looks like a secret, 0 to 1."""
    found = URL_PASSWORD.search(value)
    if found:
        return 0.0 if PLACEHOLDERS.search(found[1]) or found[1].startswith(("$", "{", "%")) else 0.9
    if not LEAST <= len(value) <= MOST or PLACEHOLDERS.search(value) or re.search(r"\s", value):
        return 0.0
    n = len(value)
    counts = {c: value.count(c) for c in set(value)}
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
    plain = bool(re.fullmatch(r"[A-Za-z]+(?:[-_. ][A-Za-z]+)*", value))
    return min(1.0, entropy / 3.0) * (0.35 if plain else 0.6 if kinds < 2 else 1.0)


def _name_before(text: str, at: int) -> str | None:
    """The name that ends before `at`: an identifier, a quoted key, or a quoted subscript."""
    q = at - 1
    while q >= 0 and text[q] in " \t":
        q -= 1
    if q >= 1 and text[q] == "]" and text[q - 1] in "\"'":
        q -= 1
    if q >= 0 and text[q] in "\"'`":
        start = text.rfind(text[q], 0, q)
        name = text[start + 1 : q] if start >= 0 else ""
        return name if name and "\n" not in name else None
    end = q + 1
    while q >= 0 and NAME_CHAR.match(text[q]):
        q -= 1
    return text[q + 1 : end] or None


class Constants:
    """Names read so far: value, and the places of the literals it was put together from."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[str, tuple]] = {}

    def get(self, name: str) -> tuple[str, tuple] | None:
        return self.known.get(name) or self.known.get(name.rpartition(".")[2])

    def put(self, name: str, value: str, places: tuple) -> None:
        if 0 < len(value) <= MOST and 0 < len(places) <= PARTS:
            self.known[name] = (value, places)
        else:
            self.known.pop(name, None)

    def literal(self, text: str, start: int, end: int) -> tuple[str, tuple]:
        """A literal's value with the names inside it put in, and all places it comes from."""
        raw = text[start:end]
        if len(raw) > MOST or not ("$" in raw or "%" in raw or "{" in raw):
            return raw, ((start, end),)
        out, places, at, own = [], [], 0, False
        for m in REFERENCE.finditer(raw):
            found = self.get(next(g for g in m.groups() if g))
            if found is None:
                continue
            own |= m.start() > at
            out += [raw[at : m.start()], found[0]]
            places += found[1]
            at = m.end()
        if at < len(raw) or not places:
            own = True
        out.append(raw[at:])
        return "".join(out), tuple(dict.fromkeys([*(((start, end),) if own else ()), *places]))


def _right_side(text: str, at: int, known: Constants) -> tuple[str, tuple] | None:
    """Value and places of the expression at `at`; None where there is no literal or known name."""
    while at < len(text) and text[at] in " \t":
        at += 1
    out, places, size, n = [], [], 0, 0
    while at < len(text):
        m = STRING.match(text, at)
        if m:
            k = m.lastindex or 1
            value, own = known.literal(text, *m.span(k))
        else:
            m = BARE.match(text, at)
            if not m:
                break
            word = m[0]
            found = known.get(word.lstrip("$@")) if IDENTIFIER.match(word) else None
            if found is None and n:
                break  # a call, or a name that is not known: what comes before stands
            value, own = found or known.literal(text, *m.span())
        out.append(value)
        places += own
        size, n, at = size + len(value), n + 1, m.end()
        if size > MOST or n > PARTS:
            return None
        m = JOIN.match(text, at)
        if not m or m.end() == at and text[at : at + 1] not in ("'", '"', "`") or not out:
            break
        at = m.end()
    return ("".join(out), tuple(dict.fromkeys(places))) if out else None


def assignments(text: str) -> Iterator[tuple[str, str, tuple]]:
    """(name, value, places of its literals) of each assignment, in order; constants are put in."""
    known = Constants()
    for m in OPERATOR.finditer(text):
        at = m.start()
        if m[0] == "<":
            tag = TAG.match(text, at)
            if not tag:
                continue
            name, found = tag[1], known.literal(text, *tag.span(2))
        elif m[0] == "--":
            flag = FLAG.match(text, at)
            if not flag:
                continue
            name, found = flag[1], _right_side(text, flag.end(), known)
        else:
            name = _name_before(text, at)
            if name is None or text.startswith("//", m.end()):  # an address, not a pair
                continue
            found = _right_side(text, m.end(), known)
        if found:
            known.put(name, *found)
            yield name, *found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    for kind, (pattern, group, least) in PATTERNS.items():
        found += [(kind, *m.span()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return found


def literal_spans(text: str, base: list[tuple[str, int, int]], threshold: float) -> list[tuple[str, int, int, str, float]]:
    """(literal, start, end, name, score) of each literal that ends up under a sensitive name, at its best score."""
    best: dict[tuple[int, int], tuple[float, str]] = {}
    for name, value, places in assignments(text):
        weight = 0.8 if "://" in value and URL_PASSWORD.search(value) else name_weight(name)  # an address tells by itself
        score = weight * value_weight(value) if weight else 0.0
        if score >= threshold:
            for place in places:
                if place not in best or score > best[place][0]:
                    best[place] = (score, name)
    inside = sorted((s, e) for kind, s, e in base if kind == "assign")
    out, k = [], 0
    for (s, e), (score, name) in sorted(best.items()):
        while k < len(inside) and inside[k][1] <= s:
            k += 1
        if e > s and not (k < len(inside) and inside[k][0] <= s and e <= inside[k][1]):
            out.append(("literal", s, e, name, round(score, 4)))
    return out


def _order(span: tuple) -> tuple:
    return span[1], KINDS.index(span[0]), span[2]


def spans(text: str, threshold: float = 0.6) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, str, float]]]:
    """Base spans and literal spans of one text, each in order."""
    base = sorted(base_spans(text), key=_order)
    return base, literal_spans(text, base, threshold)


def _joined(found: list[tuple]) -> str:
    return ",".join(f"{x[0]}:{x[1]}:{x[2]}" for x in found)


DIGEST_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_literal long, base_sha256 string, spans string"


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.6) -> DataFrame:
    """For each row the numbers of its spans by kind, the digest of base spans, and all spans as one string."""
    names = [x.split()[0] for x in DIGEST_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names[1:]]
            for value in batch.column(1):
                base, more = spans(value.as_py() or "", threshold)
                kinds = [x[0] for x in (*base, *more)]
                row = [*(kinds.count(k) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted([*base, *more], key=_order))]
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, kinds)], names=names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, DIGEST_SCHEMA)


SPAN_TYPE = "array<struct<kind:string,start:int,end:int,name:string,score:double>>"


def _span_column(threshold: float):
    @F.arrow_udf(SPAN_TYPE)
    def found(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("score", pa.float64())]))
        rows = []
        for value in texts:
            base, more = spans(value.as_py() or "", threshold)
            every = sorted([*((*x, None, None) for x in base), *more], key=_order)
            rows.append([dict(zip(("kind", "start", "end", "name", "score"), x, strict=True)) for x in every])
        return pa.array(rows, kind)

    return found


def scan(docs: DataFrame, text_col: str = "text", threshold: float = 0.6) -> DataFrame:
    """docs with a column `secrets` (or a free name like it): kind, start, end, target name and score of each span."""
    [name] = free(docs, "secrets")
    return docs.withColumn(name, _span_column(threshold)(F.col(text_col)))


def redact(docs: DataFrame, text_col: str = "text", threshold: float = 0.6, mark: str = "[secret]") -> DataFrame:
    """docs with each maximal run of overlapping spans replaced by `mark`; null texts stay null."""
    [name] = free(docs, "secrets")
    found = docs.withColumn(name, _span_column(threshold)(F.col(text_col)))
    text, start = F.col(text_col), lambda x: x["start"]
    step = lambda acc, x: F.struct(  # noqa: E731  text so far, and up to where it is read
        F.when(start(x) >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, start(x) - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
        F.greatest(acc["at"], x["end"]).alias("at"),
    )
    done = F.aggregate(F.col(name), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(text.isNotNull(), done)).select(*docs.columns)
