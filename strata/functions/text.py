"""Scalar text functions: identities, selectors, classifications, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def normalized(text: Column) -> Column:
    """Trimmed, runs of white space as one space, and - where nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", " "), F.lit("")), F.lit("-"))


def signature(body: Column) -> Column:
    """A declaration's header: the trimmed body up to its first brace or line end, white space collapsed."""
    trimmed = F.regexp_replace(body, r"^\s+|\s+$", "")
    header = F.substring_index(F.substring_index(trimmed, "{", 1), "\n", 1)
    return F.regexp_replace(F.regexp_replace(header, r"^\s+|\s+$", ""), r"\s+", " ")


def identity_key(kind: Column, decl_kind: Column, receiver: Column, name: Column, sig: Column, ordinal: Column, before: Column, after: Column) -> Column:
    """What matches an entity across revisions; an interstitial goes by the keys of its neighbours."""
    number = ordinal.cast("string")
    declared = F.concat_ws(":", F.lit("decl"), decl_kind, receiver, name, normalized(sig), number)
    between = F.concat_ws(":", F.lit("between"), F.coalesce(before, F.lit("")), F.coalesce(after, F.lit("")))
    return F.when(kind == "declaration", declared).when(kind == "interstitial", between).otherwise(F.concat_ws(":", kind, number))


def object_hash(kind: Column, content: Column) -> Column:
    """SHA-256 of the envelope "kind length NUL content"; the length is in bytes."""
    head = F.concat(kind, F.lit(" "), F.octet_length(content).cast("string"), F.lit("\0"))
    return F.sha2(F.concat(head.cast("binary"), content.cast("binary")), 256)


# File name extensions and their languages.
LANGUAGES = {
    "go": "go", "py": "python", "rs": "rust", "ts": "typescript", "tsx": "typescript",
    "js": "javascript", "jsx": "javascript", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "java": "java",
}


def language(path: Column) -> Column:
    found = F.lit("")
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    for ending, name in LANGUAGES.items():
        found = F.when(extension == ending, name).otherwise(found)
    return found


def is_hash(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))


def file_mode(mode: Column) -> Column:
    return F.when(mode == "100755", "100755").otherwise("100644")


def split_selector(selector: Column) -> tuple[Column, Column]:
    """path and key of ``path::key``, cut at the first ``::``; no key gives null."""
    at = F.locate("::", selector)
    path = F.when(at > 0, F.substring(selector, F.lit(1), at - 1)).otherwise(selector)
    return path, F.when(at > 0, F.substring(selector, at + 2, F.length(selector)))


def key_name(key: Column) -> Column:
    """The name in a change key: the fourth part of ``decl:``, after the receiver's dot of ``method:``, else the rest."""
    rest = F.substring(key, F.locate(":", key) + 1, F.length(key))
    return (
        F.when(key.startswith("decl:"), F.get(F.split(key, ":"), F.lit(3)))
        .when(key.startswith("method:"), F.substring_index(rest, ".", -1))
        .otherwise(rest)
    )


def lfs_pointer(text: Column) -> Column:
    """struct<oid, size> of a large-file pointer, or null."""
    oid = F.regexp_extract(text, r"(?m)^oid sha256:([0-9a-f]{64})$", 1)
    size = F.regexp_extract(text, r"(?m)^size ([0-9]+)$", 1)
    real = text.startswith("version ") & (oid != "") & (size != "")
    return F.when(real, F.struct(oid.alias("oid"), size.cast("long").alias("size")))


def lfs_pointer_text(oid: Column, size: Column) -> Column:
    return F.format_string("version https://git-lfs.github.com/spec/v1\noid sha256:%s\nsize %d\n", oid, size)


def bisect_steps(candidates: Column) -> Column:
    return F.when(candidates <= 1, F.lit(0)).otherwise(F.ceil(F.log2(candidates))).cast("long")


def mentions(body: Column, name: str) -> Column:
    """Whether ``name`` stands in ``body`` between characters that are no letter, digit or underscore."""
    return body.rlike(rf"(?<![A-Za-z0-9_])\Q{name}\E(?![A-Za-z0-9_])")


def glob_regex(glob: str, star: str = "[^/]*", one: str = "[^/]") -> str:
    """A pattern with * and ? (within a path part) and ** (across parts) as an anchored regular expression."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            c = glob[i]
            out.append(star if c == "*" else one if c == "?" else c if c.isalnum() or c in "_/" else "\\" + c)
            i += 1
    return "^" + "".join(out) + "$"
