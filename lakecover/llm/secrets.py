"""Operator 11: secrets in texts, by a keyword automaton, patterns anchored at its hits, and checksums."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exchange import bounded_batches
from .text import LOWER

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "npm", "card")
HEX_RUN = 24
SPAN = T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)])

#: The words that begin a match of each kind, in lower case.
WORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "card": ("card",),
}
#: What a match looks like from its word on.
PATTERNS = {
    "assign": re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
    "github": re.compile(r"gh[pousr]_([A-Za-z0-9]+)"),
    "npm": re.compile(r"npm_([A-Za-z0-9]+)"),
    "card": re.compile(r"(?ai:card)[^0-9\n]{0,20}([0-9](?:[ -]?[0-9])*)"),
}
DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_token(body: str) -> bool:
    """Whether 36 characters end in the CRC-32 of those before, in six digits of base 62."""
    crc, digits = zlib.crc32(body[:30].encode()), ""
    for _ in range(6):
        crc, d = divmod(crc, 62)
        digits = DIGITS62[d] + digits
    return len(body) == 36 and body[30:] == digits


def luhn(number: str) -> bool:
    """Whether 13 to 19 digits, not all the same, end in the check digit of card numbers; separators don't count."""
    digits = [int(c) for c in number if c.isdecimal()]
    doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
    return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and sum(doubled) % 10 == 0


#: A match that fails its test is dropped, and what it covers is not searched again for its kind.
TESTS: dict[str, Callable[[re.Match], bool]] = {
    "assign": lambda m: len(m[1]) >= 6,
    "access": lambda m: len(m[0]) >= 20,
    "hex": lambda m: len(m[0]) >= HEX_RUN,
    "github": lambda m: crc_token(m[1]),
    "npm": lambda m: crc_token(m[1]),
    "card": lambda m: luhn(m[1]),
}
_FOLD = bytes(LOWER)
_RUNS = bytes(c if c >= 0x80 else ord("h") if chr(c) in "0123456789abcdef" else ord(" ") for c in range(256))


def _automaton(words: dict[str, str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for word, kind in words.items():
        made.add_word(word, (kind, len(word)))
    made.make_automaton()
    return made


class Scanner:
    """Spans of secrets in a text; positions are code points."""

    def __init__(self) -> None:
        self.words = _automaton({w: kind for kind, words in WORDS.items() for w in words})
        self.runs = _automaton({"h" * HEX_RUN: "hex"})

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then kind as listed; per kind leftmost and not overlapping.

        A pattern is tried only where the automaton has found one of its words, and from the hit
        on: a pattern can begin nowhere else. Hexadecimal runs have no word; there the automaton
        looks for 24 hexadecimal digits in the text with its characters replaced by classes, and
        goes on after the run.
        """
        data = text.encode("utf-8", "surrogatepass")
        found = []
        at: dict[str, list[int]] = defaultdict(list)
        for end, (kind, length) in self.words.iter(data.translate(_FOLD).decode("utf-8", "surrogatepass")):
            at[kind].append(end + 1 - length)
        for kind, starts in at.items():
            pattern, test, done = PATTERNS[kind], TESTS[kind], 0
            for start in sorted(starts):
                if start >= done and (m := pattern.match(text, start)):
                    done = m.end()
                    if test(m):
                        found.append((kind, start, done))
        classes, done = data.translate(_RUNS).decode("utf-8", "surrogatepass"), 0
        while hit := next(self.runs.iter(classes, done), None):
            start = hit[0] + 1 - HEX_RUN
            done = PATTERNS["hex"].match(text, start).end()
            found.append(("hex", start, done))
        return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def find_secrets(docs: DataFrame, redact: bool = False) -> DataFrame:
    """Adds ``secrets``, the spans (kind, start, end) in ``text``; with ``redact`` also ``clean_text``, where each is ``[kind]``.

    Base kinds are assignments to words like password, access keys and hexadecimal runs; the
    others (github, npm, card) hold a checksum, which must be right. Overlapping spans of several
    kinds all count; of these redaction replaces the first by (start, kind as listed), and what
    sticks out of it by the next. One narrow pass: nothing is shuffled, and a task holds one
    batch of rows. A null text is null in ``clean_text`` and has no spans, nor has an empty one. A long
    text is read whole. Repeated rows and ids don't matter; other columns are kept, clashing ones
    replaced. An empty table gives an empty one.
    """
    plain = docs.drop("secrets", "clean_text")
    bounded_batches(docs.sparkSession)
    schema = T.StructType([*plain.schema.fields, T.StructField("secrets", T.ArrayType(SPAN, False), False), *([T.StructField("clean_text", T.StringType())] if redact else [])])
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            spans, clean = [], []
            for value in batch["text"]:
                text = value.as_py()
                found = scanner.spans(text or "")
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
                if redact:
                    clean.append(None if text is None else redacted(text, found))
            columns = [*batch.columns, pa.array(spans, spans_type), *([pa.array(clean, pa.string())] if redact else [])]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return plain.mapInArrow(scan, schema)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span as its kind in brackets."""
    out, done = [], 0
    for kind, start, end in spans:
        if end > done:
            out += [text[done : max(start, done)], f"[{kind}]"]
            done = end
    return "".join([*out, text[done:]])


def count_of(kind: str) -> Column:
    return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")


def joined(base: bool) -> Column:
    """``kind:start:end`` of all spans, or of the base kinds, comma-joined."""
    spans = F.filter("secrets", lambda s: s["kind"].isin(*BASE)) if base else F.col("secrets")
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
