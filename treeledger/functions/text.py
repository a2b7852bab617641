"""Names that are allowed, patterns, and the lines that listings and logs print."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeledger.errors import InvalidConflictResolution, InvalidRef, RemoteNotFound
from treeledger.functions.hashing import col, short

#: What a short listing shows for each kind.
KIND_MODES = {"regular": "100644", "symlink": "120000", "directory": "040000", "block_device": "060000", "char_device": "020000", "fifo": "010000", "socket": "140000", "hardlink": "100644"}
#: File type bits of a mode, with letter and kind.
TYPE_BITS = {0o100000: ("-", "regular"), 0o040000: ("d", "directory"), 0o120000: ("l", "symlink"), 0o060000: ("b", "block_device"), 0o020000: ("c", "char_device"), 0o010000: ("p", "fifo"), 0o140000: ("s", "socket")}


def choose(value: Column, table: dict, default: Column) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)) if out is None else out.when(value == k, F.lit(v))
    return out.otherwise(default)


def ref_name_ok(c: str | Column) -> Column:
    """Not empty, no empty, '.' or '..' component, no NUL."""
    return F.coalesce((col(c) != "") & ~F.contains(col(c), F.lit("\0")) & ~F.exists(F.split(col(c), "/"), lambda x: x.isin("", ".", "..")), F.lit(False))


def entry_name_ok(c: str | Column) -> Column:
    return F.coalesce(~col(c).isin("", ".", "..") & ~F.contains(col(c), F.lit("/")) & ~F.contains(col(c), F.lit("\0")), F.lit(False))


def glob_regex(pattern: str) -> str:
    """An anchored regex for a glob; * crosses slashes, [!x] negates."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
            while i + 1 < len(pattern) and pattern[i + 1] == "*":
                i += 1
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] == "!"))
            if end < 0:
                raise InvalidRef(f"pattern {pattern!r} has an open bracket")
            inner = pattern[i + 1 : end]
            negated = inner.startswith("!")
            body = inner[negated:].replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]").replace("^", "\\^").replace("&", "\\&")
            out.append(f"[{'^' if negated else ''}{body}]")
            i = end
        else:
            out.append("\\" + c if c in r"\.^$+{}()|]" else c)
        i += 1
    return "(?s)^" + "".join(out) + "$"


def policy(text: str) -> str:
    """error, first or last, in any case."""
    if text.lower() not in ("error", "first", "last"):
        raise InvalidConflictResolution(text)
    return text.lower()


def remote_parts(address: str) -> tuple[str | None, str]:
    """(user, host) of user@host; without a user the host alone, and an empty part raises."""
    user, at, host = address.rpartition("@")
    if not host or at and not user:
        raise RemoteNotFound(address)
    return user or None, host


def kind_of_mode(mode: str | Column) -> Column:
    """The kind that a mode's type bits name; regular if none."""
    return choose(col(mode).bitwiseAND(0o170000), {k: v[1] for k, v in TYPE_BITS.items()}, F.lit("regular"))


def permissions(mode: str | Column) -> Column:
    """Ten characters such as -rwxr-xr-x; bits above the nine are not shown."""
    m = col(mode).cast("long")
    letters = [F.when(m.bitwiseAND(0o400 >> i) != 0, F.lit("rwx"[i % 3])).otherwise(F.lit("-")) for i in range(9)]
    return F.concat(choose(m.bitwiseAND(0o170000), {k: v[0] for k, v in TYPE_BITS.items()}, F.lit("?")), *letters)


def human_size(size: str | Column) -> Column:
    """At most five characters: plain below 1024, else in K, M, G, T or P."""
    n = col(size).cast("double")
    out = F.when(n < 1024, F.format_string("%5d", col(size).cast("long")))
    for k, unit in enumerate("KMGTP", 1):
        x = n / float(1024**k)
        text = F.when(x >= 10, F.format_string(f"%4.0f{unit}", F.bround(x, 0))).otherwise(F.format_string(f"%3.1f{unit}", F.bround(x, 1)))
        out = out.when(x < 1024, text) if unit != "P" else out.otherwise(text)
    return out


def short_line(path="path", kind="kind", hash="hash") -> Column:
    shown = F.coalesce(short(hash), F.lit("-" * 12))
    return F.concat(choose(col(kind), KIND_MODES, F.lit("??????")), F.lit(" "), col(kind), F.lit(" "), shown, F.lit("    "), col(path))


def long_line(human: bool = False, path="path", kind="kind", target="target_path") -> Column:
    """Needs m_mode, m_uid, m_gid and m_size, which are null where nothing is known."""
    perms = F.when(F.col("m_mode").isNull(), F.lit("-" * 10)).otherwise(permissions("m_mode"))
    size = F.coalesce("m_size", F.lit(0))
    shown = human_size(size) if human else F.lpad(size.cast("string"), 8, " ")
    shown = shown if human else F.when(F.length(size.cast("string")) > 8, size.cast("string")).otherwise(shown)
    pad = lambda c: F.when(F.length(c) >= 5, c).otherwise(F.lpad(c, 5, " "))
    line = F.concat_ws(" ", perms, pad(F.coalesce("m_uid", F.lit(0)).cast("string")), pad(F.coalesce("m_gid", F.lit(0)).cast("string")), shown, col(path))
    return F.when(col(kind) == "hardlink", F.concat(line, F.lit(" -> "), col(target))).otherwise(line)


def date_text(timestamp: str | Column) -> Column:
    """Seconds since the epoch as a date and time, UTC session assumed."""
    return F.date_format(F.timestamp_seconds(col(timestamp)), "yyyy-MM-dd HH:mm:ss")


def log_text(hash="hash", author="author", timestamp="timestamp", message="message") -> Column:
    """A commit as the log prints it."""
    head = F.concat(F.lit("commit "), col(hash), F.lit("\nAuthor: "), col(author), F.lit("\nDate:   "), date_text(timestamp), F.lit("\n"))
    return F.concat(head, F.when(col(message) == "", F.lit("")).otherwise(F.concat(F.lit("\n    "), F.replace(col(message), F.lit("\n"), F.lit("\n    ")), F.lit("\n"))))


def megabytes(size: str | Column) -> Column:
    return F.format_string("%.1f", col(size).cast("double") / 1e6)
