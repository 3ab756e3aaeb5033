"""Schema hashes: which payloads fit the tables here."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from driftmerge.plans.spec import TableSpec

# Fixed values of 64-bit FNV-1a.
FNV_BASIS = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3

_TOKEN = re.compile(r"(?P<comment>--[^\n]*\n?|/\*.*?(?:\*/|\Z))|(?P<quoted>'(?:[^']|'')*'?|\"(?:[^\"]|\"\")*\"?)|(?P<space>[ \t\n\v\f\r]+)|(?P<other>.)", re.S)


def normalised(ddl: str) -> str:
    """ddl without comments, line ends, tabs, semicolons and needless spaces, in lower case but for quoted parts."""
    out: list[str] = []
    spaced = True
    for m in _TOKEN.finditer(ddl):
        text = m.group()
        if m.lastgroup == "comment":
            continue
        if m.lastgroup == "quoted":
            out.append(text)
            spaced = False
        elif m.lastgroup == "space":
            if " " not in text:
                continue
            if ddl[m.end() : m.end() + 1] in ("", "(", ")", ",", ";"):
                spaced = True
            elif not spaced:
                out.append(" ")
                spaced = True
        elif text == ";":
            spaced = True
        elif " " < text <= "~":
            out.append(text.lower())
            spaced = False
    return "".join(out)


def fnv1a(text: str) -> int:
    """Unsigned 64-bit hash of the text's UTF-8 bytes."""
    h = FNV_BASIS
    for byte in text.encode():
        h = (h ^ byte) * FNV_PRIME & 0xFFFF_FFFF_FFFF_FFFF
    return h


def schema_hash(specs: Iterable[TableSpec]) -> int:
    """Of all replicated tables, whatever order they were enabled in."""
    return fnv1a(normalised("".join(s.ddl() for s in sorted(specs, key=lambda s: s.name.lower()))))


class SchemaMismatch(ValueError):
    """A payload made under a schema that was never in force here."""


@dataclass
class SchemaHistory:
    """Hashes of the schemas so far, oldest first; a hash that comes back moves to the end."""

    hashes: list[int] = field(default_factory=list)

    def update(self, specs: Iterable[TableSpec]) -> bool:
        """Add the specs' hash; whether the newest changed."""
        h = schema_hash(specs)
        if self.hashes[-1:] == [h]:
            return False
        self.hashes = [x for x in self.hashes if x != h] + [h]
        return True

    @property
    def current(self) -> int:
        return self.hashes[-1] if self.hashes else 0

    def accepts(self, h: int) -> bool:
        """Current or earlier schemas; tables are only ever widened, so earlier changes still fit."""
        return h in self.hashes

    def require(self, h: int) -> None:
        if not self.accepts(h):
            raise SchemaMismatch(f"the schema hash {h} is unknown here")
