"""Names of numbered files, told by one format field such as ``part-{:05d}.tar``."""

from __future__ import annotations

import re
import string

NUMBERED = string.Formatter()


def _parts(pattern: str) -> tuple[str, str, str]:
    """What stands before the field, its format, and what stands behind it."""
    found = list(NUMBERED.parse(pattern))
    fields = [i for i, (_, name, _, _) in enumerate(found) if name is not None]
    if len(fields) != 1 or not re.fullmatch(r"(0\d+)?d?", found[fields[0]][2]):
        raise ValueError(f"{pattern!r} needs one field for a number, like {{:08d}}")
    text = "".join(t for t, _, _, _ in found[: fields[0] + 1])
    return text, found[fields[0]][2], "".join(t for t, _, _, _ in found[fields[0] + 1 :])


def number_regex(pattern: str) -> str:
    """A regular expression that fits the names that ``pattern`` gives, and no others; its group is the number."""
    before, field, behind = _parts(pattern)
    width = int(field.rstrip("d") or 1)
    return f"^{re.escape(before)}([0-9]{{{width}}}|[1-9][0-9]{{{width},}}){re.escape(behind)}$"


def name_glob(pattern: str) -> str:
    """A file pattern that fits these names, and maybe others."""
    before, _, behind = _parts(pattern)
    return re.sub(r"([][*?{}\\])", "?", before) + "*" + re.sub(r"([][*?{}\\])", "?", behind)


def stats_name(pattern: str, name: str, number: int) -> str:
    """The name of a shard's stats: from its number, or by a plain ``{}`` from its name without ``.tar``."""
    by_name = any(field is not None and not spec for _, field, spec, _ in NUMBERED.parse(pattern))
    return pattern.format(name.removesuffix(".tar") if by_name else number)
