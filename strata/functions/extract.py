"""Entities of source files: a partition of the text into named pieces.

The pieces of a file are in order, contiguous, and give the text when put
together.  A piece is a preamble (a package clause, or what comes before all else),
an import block, a declaration, a statement, what closes a container, or an
interstitial: white space, a comment that stands alone, one that documents the next
piece, or a note on the last line of the one before.  ``strata.functions.cutter``
finds them; a text without grammar or without declarations is one interstitial.

Keys identify a piece across revisions.  A declaration goes by kind, container, name and
header, a comment by what it says or documents, a statement by its head; white space
alone goes by its neighbours, so only white space can be moved by an insertion.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from strata.functions.cutter import Piece, cut


def pieces(text: str, language: str) -> list[tuple[int, int, str, str, str, str]]:
    """(start, end, kind, decl_kind, receiver, name) of all pieces of a text; an empty text has none."""
    return [(p.start, p.end, p.kind, p.decl_kind, p.receiver, p.name) for p in cut(text, language)]


def signature(body: str) -> str:
    """A declaration's header: up to its first brace or line end, white space collapsed."""
    return " ".join(body.partition("{")[0].strip().partition("\n")[0].split())


_ROW = T.StructType(
    [
        T.StructField(name, kind())
        for name, kind in (
            ("pos", T.IntegerType), ("kind", T.StringType), ("decl_kind", T.StringType), ("receiver", T.StringType), ("name", T.StringType),
            ("signature", T.StringType), ("ordinal", T.IntegerType), ("key", T.StringType), ("body", T.StringType), ("body_hash", T.StringType),
            ("start_byte", T.LongType), ("end_byte", T.LongType), ("start_line", T.IntegerType), ("end_line", T.IntegerType),
        )
    ]
)


def keyed(text: str, language: str) -> list[tuple[Piece, str, str, str, int]]:
    """(piece, body, key, signature, ordinal) of a text's pieces; ordinals count earlier pieces that would have the same key."""
    seen: dict[str, int] = {}
    out: list[tuple[Piece, str, str, str, int]] = []
    before, waiting = "", []
    for p in cut(text or "", language or ""):
        body, header, kind = text[p.start : p.end], "", p.kind
        if kind == "interstitial" and p.label != "comment":  # goes by its neighbours
            if p.label == "note":
                out.append((p, body, f"note:{before}", "", 0))
            else:
                waiting.append(len(out))
                out.append((p, body, before, "", 0))
            continue
        if kind == "declaration":
            header = signature(body)
            base = f"decl:{p.decl_kind}:{p.receiver}:{p.name}:{header or '-'}"
        elif kind == "statement":
            base = f"stmt:{p.receiver}:{p.label}"
        elif kind == "closing":
            base = f"closing:{p.label}"
        elif p.label == "comment":
            base = f"comment:{hashlib.sha256(body.strip().encode()).hexdigest()}"
        else:
            base = kind
        ordinal = seen.get(base, 0)
        seen[base] = ordinal + 1
        key = f"{base}:{ordinal}"
        if kind != "interstitial":
            for i in waiting:
                out[i] = _placed(out[i], key)
            before, waiting = key, []
        out.append((p, body, key, header, ordinal))
    for i in waiting:
        out[i] = _placed(out[i], "")
    return out


def _placed(row: tuple[Piece, str, str, str, int], after: str) -> tuple[Piece, str, str, str, int]:
    p, body, before, header, ordinal = row
    return p, body, f"doc:{after}" if p.label == "doc" else f"between:{before}:{after}", header, ordinal


def entities(text: str, language: str) -> list[dict]:
    """The rows of a text's pieces."""
    byte, line, out = 0, 1, []
    for pos, (p, body, key, header, ordinal) in enumerate(keyed(text, language)):
        data = body.encode()
        last = line + body.count("\n")
        out.append(
            {
                "pos": pos, "kind": p.kind, "decl_kind": p.decl_kind, "receiver": p.receiver, "name": p.name, "signature": header, "ordinal": ordinal,
                "key": key, "body": body, "body_hash": hashlib.sha256(data).hexdigest(), "start_byte": byte, "end_byte": byte + len(data),
                "start_line": line, "end_line": last - body.endswith("\n"),
            }
        )
        byte, line = byte + len(data), last
    return out


class ExtractEntities:
    """``entities`` as a table function."""

    def eval(self, text: str, language: str) -> Iterator[tuple]:
        for e in entities(text, language):
            yield tuple(e.values())


extract_entities = udtf(ExtractEntities, returnType=_ROW)


def extracted(files: DataFrame, keys: list[str], text: str = "text", language: str = "lang", only: Sequence[str] = (), kinds: Sequence[str] = ()) -> DataFrame:
    """``keys`` of each file with its entities, one row each, in Arrow batches; null texts have none.

    What is not among the columns ``only`` or the ``kinds`` does not leave Python (none named: all do).
    """
    fields = [f for f in files.schema.fields if f.name in keys]
    fields.sort(key=lambda f: keys.index(f.name))
    found = [f for f in _ROW.fields if not only or f.name in only]
    out = T.StructType([*fields, *found])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = {T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.StringType(): pa.string()}
        for batch in batches:
            at, columns = [], {f.name: [] for f in found}
            for i, (body, lang) in enumerate(zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist(), strict=True)):
                for e in entities(body, lang):
                    if kinds and e["kind"] not in kinds:
                        continue
                    at.append(i)
                    for name, column in columns.items():
                        column.append(e[name])
            own = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(columns[f.name], arrow[f.dataType]) for f in found)], [*keys, *columns])

    return files.select(*keys, text, language).mapInArrow(rows, out)
