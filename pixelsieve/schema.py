"""Kinds of hashes and their fixed properties."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class HashSpec:
    """A fixed-width bit string; rows fewer than ``below`` bits apart are duplicates (0: only equal ones)."""

    name: str
    nbits: int
    below: int = 0

    @property
    def nbytes(self) -> int:
        return self.nbits // 8

    @property
    def words(self) -> int:
        return self.nbits // 64


MD5 = HashSpec("md5", 128)
DHASH = HashSpec("dhash", 512, 60)
PHASH = HashSpec("phash", 256, 50)
SPECS = {s.name: s for s in (MD5, DHASH, PHASH)}
