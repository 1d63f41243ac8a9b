"""Secrets by pattern and by token efficiency.

Three patterns find assigned credentials, access keys and long hex strings.  The
token-efficiency test adds what no pattern names: runs of key characters that a
tokenizer's vocabulary, learned from ordinary text, can only spell in short
pieces.  A run of at least ``LEAST_RUN`` characters with at most ``RATIO``
characters per token is random, unless it is a known digest (hex of the length
of a common hash), a UUID, a number, or an identifier made of words.  In a run
that passes as a whole, the parts between separators and the stretches of tokens
that slide over it, ``LEAST_RUN`` characters or a little more, are held to the
same ratio, so words beside a secret do not cover it.  There separators, numbers
and single characters between separators count neither way.  A run that has the
form of an identifier (letters of one case or capitalized, numbers, separators)
is judged in this second way alone: it is made of words if the vocabulary spells
its parts in long pieces.

Offsets are code points, ends exclusive.  Defined results: null and empty texts
have no spans; of a run that overlaps a pattern's span the rest is tested, and
failing stretches that overlap or touch are one span; rows that repeat
each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from strata.llm.pretokens import merges

VOCABULARY = "byte_bpe_50k.json"
LEAST_RUN = 16
RATIO = 1.9

# The patterns of the contract.  A failing match still uses up its
# text for `assign`; for the two others the shortest length can stand in the
# pattern, because what is left of a run that is too short is shorter still.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "token")

RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % LEAST_RUN)
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
DIGEST_LENGTHS = frozenset({32, 40, 56, 64, 96, 128})
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
INNER_UUID = re.compile(rf"(?<![A-Za-z0-9]){UUID.pattern}(?![A-Za-z0-9])")
PART = re.compile(r"[A-Za-z0-9]+")
# each character has one way through the pattern, so a run is read in linear time
IDENTIFIER = re.compile(r"[_=+/-]*(?:(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[_=+/-]+|$))+|(?:[a-z]{2,}|[A-Z][a-z]{2,})(?:[A-Z][a-z]{2,})*[0-9]*")


def known(run: str) -> bool:
    """Whether the run is a digest or a UUID."""
    return bool(UUID.fullmatch(run) or len(run) in DIGEST_LENGTHS and DIGEST.fullmatch(run))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = []
    lower = text.lower() if len(text) else ""
    if any(w in lower for w in ASSIGN_WORDS):
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text)]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    return spans


def rests(run: str, at: int, taken: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """What of the run, which starts at ``at``, stands outside the spans, the UUIDs and the digests in it."""
    gone = [(max(a - at, 0), b - at) for _, a, b in taken if a < at + len(run) and at < b]
    gone += [m.span() for m in INNER_UUID.finditer(run)]
    gone += [m.span() for m in PART.finditer(run) if len(m[0]) in DIGEST_LENGTHS and DIGEST.fullmatch(m[0])]
    begin = 0
    for a, b in [*sorted(gone), (len(run), len(run))]:
        if a - begin >= LEAST_RUN:
            yield begin, a
        begin = max(begin, b)


def stretches(run: str, sizes: list[int], ratio: float) -> list[tuple[int, int]]:
    """The run, its parts and its sliding stretches, by its tokens' sizes, where they fail the ratio; merged."""
    counts = [False] * len(run)
    for m in PART.finditer(run):
        if len(m[0]) > 1 and not m[0].isdigit():
            counts[m.start() : m.end()] = [True] * len(m[0])
    ends, chars, tokens = [0], [0], [0]  # of the first i tokens; a token never crosses the end of a part
    for size in sizes:
        counted = counts[ends[-1]]
        ends.append(ends[-1] + size)
        chars.append(chars[-1] + size * counted)
        tokens.append(tokens[-1] + counted)
    place = {end: i for i, end in enumerate(ends)}
    tested = [(0, len(sizes))]
    tested += [(place[m.start()], place[m.end()]) for m in PART.finditer(run) if len(m[0]) >= LEAST_RUN]
    j = 0
    for i in range(len(sizes)):
        while j < len(sizes) and ends[j] - ends[i] < LEAST_RUN:
            j += 1
        if ends[j] - ends[i] < LEAST_RUN:
            break
        tested.append((i, j))
    merged: list[tuple[int, int]] = []
    for i, j in sorted(tested):
        n = chars[j] - chars[i]
        if 2 * n < LEAST_RUN or n > ratio * (tokens[j] - tokens[i]) or known(run[ends[i] : ends[j]]):
            continue
        if merged and ends[i] <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], ends[j]))
        else:
            merged.append((ends[i], ends[j]))
    return merged


def random_spans(text: str, taken: list[tuple[str, int, int]], encode, ratio: float = RATIO) -> list[tuple[str, int, int]]:
    spans = []
    for m in RUN.finditer(text):
        run, at = m.group(), m.start()
        if known(run):
            continue
        free = not IDENTIFIER.fullmatch(run) and not any(start < m.end() and at < end for _, start, end in taken)
        if free and len(run) <= ratio * len(encode(run)):
            spans.append(("token", at, m.end()))
            continue
        for a, b in rests(run, at, taken):
            sizes = [len(x) for x in encode(run[a:b])]
            spans += [("token", at + a + x, at + a + y) for x, y in stretches(run[a:b], sizes, ratio)]
    return spans


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


def scan(docs: DataFrame, vocabulary: str = VOCABULARY, ratio: float = RATIO) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_token, base_sha256, spans."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coding = merges(vocabulary)

        def encode(run: str) -> list[bytes]:
            return coding.decode_tokens_bytes(coding.encode_ordinary(run))

        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            hashes, lists = [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                every = base + random_spans(text or "", base, encode, ratio)
                for own, kind in zip(counts, KINDS, strict=True):
                    own.append(sum(s[0] == kind for s in every))
                hashes.append(hashlib.sha256(joined(base).encode()).hexdigest())
                lists.append(joined(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in counts), pa.array(hashes, pa.string()), pa.array(lists, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_token", "base_sha256", "spans"],
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(
        find, "doc_id long, n_assign long, n_access long, n_hex long, n_token long, base_sha256 string, spans string"
    )
