"""Secret scans through a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams which any matching text must satisfy. The
postings of a batch of documents answer the queries; candidates are verified by the expression itself over the whole
text. A rule that no trigram is mandatory for scans every document.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_views

#: Bytes whose trigrams are taken at once, so that a very long text needs bounded memory.
PIECE = 1 << 22
#: More alternatives than this are not followed; the part then gives no trigram.
MOST_STRINGS = 24


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    any_case: bool = False
    least: int = 0  # characters of group `measured` below which a match is dropped
    measured: int = 0

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


#: The three base rules, then further public key formats. The order breaks ties of a start. Each is read in
#: time linear in the text: a run of characters is entered at its start, or at a bounded number of places.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", False, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # what `[0-9a-f]+` of 24 and more characters gives: both match whole runs
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{0,30}://[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%!$&*+-]+@"),
)
BASE = ("assign", "access", "hex")

# A query is True (any text), a trigram (str), or ("and" | "or", *queries).


def both(a, b):
    return b if a is True else a if b is True or a == b else ("and", a, b)


def either(a, b):
    return True if a is True or b is True else a if a == b else ("or", a, b)


def of_strings(strings: set[str]):
    """The query of 'one of these strings occurs'."""
    query = None
    for s in sorted(strings):
        own = True
        for i in range(len(s) - 2):
            own = both(own, s[i : i + 3])
        query = own if query is None else either(query, own)
    return True if query is None else query


#: What the rules are written in: classes, groups, alternatives, repeats and single characters.
_TOKEN = re.compile(r"""(?P<behind>\(\?<!\[[^\]]*\]\))|(?P<open>\((?:\?:)?)|(?P<close>\))|(?P<bar>\|)|\[(?P<set>[^\]]*)\]|(?P<times>[?*+]|\{\d+(?:,\d*)?\})|\\x(?P<hex>[0-9A-Fa-f]{2})|\\(?P<escaped>[^A-Za-z0-9])|(?P<plain>[^\\.^$\[\](){}|?*+])""")


def _tokens(pattern: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(pattern):
        m = _TOKEN.match(pattern, at)
        if not m:
            raise ValueError(f"no trigram query for this part of a rule: {pattern[at:]}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def _class_chars(body: str) -> set[str] | None:
    """The characters of a class; None for large or negated ones."""
    chars: set[str] = set()
    for m in re.finditer(r"\\?(.)-\\?(.)|\\?(.)", body):
        chars.update(map(chr, range(ord(m[1]), ord(m[2]) + 1)) if m[1] else m[3])
    return None if body.startswith("^") or len(chars) > MOST_STRINGS else chars


def _joined(left: set[str], right: set[str]) -> set[str] | None:
    out = {a + b for a in left for b in right}
    return out if len(out) <= MOST_STRINGS else None


def _alternatives(tokens: list, at: int) -> tuple[set[str] | None, object, int]:
    """(all strings that one of the alternatives can match, or None if too many; a query that holds for any match; the
    token after them)."""
    exact, query = set(), None
    while True:
        strings, own, at = _sequence(tokens, at)
        own = of_strings(strings) if strings is not None else own
        query = own if query is None else either(query, own)
        exact = exact | strings if exact is not None and strings is not None else None
        if at >= len(tokens) or tokens[at][0] != "bar":
            return exact, query, at
        at += 1


def _sequence(tokens: list, at: int) -> tuple[set[str] | None, object, int]:
    query, run, whole = True, {""}, True  # run: the strings of the last parts that are known exactly
    while at < len(tokens) and tokens[at][0] not in ("bar", "close"):
        kind, value = tokens[at]
        own, at = True, at + 1
        if kind == "open":
            exact, own, at = _alternatives(tokens, at)
            at += 1
        elif kind == "behind":
            exact = {""}
        else:
            exact = _class_chars(value) if kind == "set" else {chr(int(value, 16)) if kind == "hex" else value}
        if at < len(tokens) and tokens[at][0] == "times":
            times, at = tokens[at][1], at + 1
            inner = of_strings(exact) if exact is not None else own
            if times == "?" and exact is not None:
                exact = exact | {""}
            else:
                exact, own = None, True if times[0] in "?*" or times.startswith("{0") else inner
        query = both(query, own if exact is None else True)
        longer = _joined(run, exact) if exact is not None and len(exact) <= MOST_STRINGS else None
        if longer is not None:
            run = longer
        else:
            query, run, whole = both(query, of_strings(run)), exact if exact is not None else {""}, False
    return (run, of_strings(run), at) if whole else (None, both(query, of_strings(run)), at)


def trigram_query(rule: Rule):
    """The rule's Boolean query over lower-cased trigrams; True if none is mandatory."""
    return _lower(_alternatives(_tokens(rule.pattern), 0)[1])


def _lower(query):
    if query is True:
        return True
    return query.lower() if isinstance(query, str) else (query[0], *(_lower(q) for q in query[1:]))


def trigrams_of(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*(trigrams_of(q) for q in query[1:]))


def code_of(trigram: str) -> int:
    a, b, c = trigram.encode("ascii")
    return a << 16 | b << 8 | c


class TrigramIndex:
    """Postings (sorted document numbers) of a batch of texts, for the trigrams that some query asks for."""

    def __init__(self, views: list, wanted: np.ndarray):
        self.size = len(views)
        raw = b"\x00\x00".join(bytes(v) for v in views).lower()
        data = np.frombuffer(raw, dtype=np.uint8)
        starts = np.cumsum([0, *(len(v) + 2 for v in views)])[:-1]
        self.postings: dict[int, np.ndarray] = {}
        found = [np.zeros(0, dtype=np.int64)]
        for begin in range(0, len(data) - 2, PIECE):
            part = data[begin : begin + PIECE + 2].astype(np.uint32)
            codes = part[:-2] << np.uint32(16) | part[1:-1] << np.uint32(8) | part[2:]
            at = np.flatnonzero(wanted[codes])
            docs = np.searchsorted(starts, at + begin, side="right") - 1
            found.append(np.unique(codes[at].astype(np.int64) << 32 | docs))
        pairs = np.unique(np.concatenate(found))
        for code, docs_of in zip(*_runs(pairs >> 32, pairs & 0xFFFFFFFF), strict=True):
            self.postings[int(code)] = docs_of

    def answer(self, query) -> np.ndarray:
        if query is True:
            return np.arange(self.size)
        if isinstance(query, str):
            return self.postings.get(code_of(query), np.zeros(0, dtype=np.int64))
        found = [self.answer(q) for q in query[1:]]
        out = found[0]
        for x in found[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
        return out


def _runs(keys: np.ndarray, values: np.ndarray):
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[starts], np.split(values, starts[1:]) if len(starts) else []


class Scanner:
    def __init__(self, rules=RULES):
        self.rules = rules
        self.patterns = [r.compiled() for r in rules]
        self.queries = [trigram_query(r) for r in rules]
        self.wanted = np.zeros(1 << 24, dtype=bool)
        for q in self.queries:
            self.wanted[[code_of(t) for t in trigrams_of(q)]] = True

    def scan(self, views: list) -> list[list[tuple[int, int, int]]]:
        """Per text the spans (start, rule number, end) in code points, in order."""
        index = TrigramIndex(views, self.wanted)
        texts: dict[int, str] = {}
        out: list[list] = [[] for _ in views]
        for number, (rule, pattern, query) in enumerate(zip(self.rules, self.patterns, self.queries, strict=True)):
            for i in index.answer(query).tolist():
                if i not in texts:
                    texts[i] = str(views[i], "utf-8")
                for m in pattern.finditer(texts[i]):
                    if m.end(rule.measured) - m.start(rule.measured) >= rule.least:
                        out[i].append((m.start(), number, m.end()))
        return [sorted(x) for x in out]


SPAN = "array<struct<kind:string,start:long,end:long>>"


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """One row per input row: key, spans (kind, start, end in code points, by start and then rule), base_sha256, spans_text.

    A null or empty text has no span; texts may be of any length. Rows with the same key or text are scanned each on its
    own; an empty table gives no rows. Further columns of docs are not read.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span)), ("base_sha256", pa.string()), ("spans_text", pa.string())])

    def scan(batches):
        scanner = Scanner(rules)
        kinds = [r.kind for r in rules]
        told = lambda spans: ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)
        for batch in batches:
            found = scanner.scan(text_views(batch.column("text")))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "spans": [[{"kind": kinds[k], "start": a, "end": b} for a, k, b in x] for x in found],
                    "base_sha256": [hashlib.sha256(told([s for s in x if kinds[s[1]] in BASE]).encode()).hexdigest() for x in found],
                    "spans_text": [told(x) for x in found],
                },
                schema=schema,
            )

    return slim.mapInArrow(scan, f"doc_id long, spans {SPAN}, base_sha256 string, spans_text string")


def secrets_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: the digest of secret_spans()."""
    found = secret_spans(docs, key, text)
    counts = [F.size(F.expr(f"filter(spans, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, "base_sha256", F.col("spans_text").alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", rules=RULES) -> DataFrame:
    """docs with every span in `text` replaced by mark (overlapping spans once), row by row; a null text stays null, and
    further columns, whatever their names, stay as they are. An empty table gives no rows."""
    small_batches(docs.sparkSession)

    def clean(batches):
        scanner = Scanner(rules)
        for batch in batches:
            column = batch.column(text)
            found, values = scanner.scan(text_views(column)), column.to_pylist()
            for i, spans in enumerate(found):
                if spans:
                    value, pieces, at = values[i], [], 0
                    for start, _, end in spans:
                        if start >= at:
                            pieces += [value[at:start], mark]
                        at = max(at, end)
                    values[i] = "".join([*pieces, value[at:]])
            yield batch.set_column(batch.schema.get_field_index(text), text, pa.array(values, pa.string()))

    return docs.mapInArrow(clean, docs.schema)
