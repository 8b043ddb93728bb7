"""Patch lists: the files of a package and which of them a patch left alone."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from ..codes import LIST_MAGIC, MODE_BLK, MODE_CHR, MODE_LNK, MODE_MASK, MODE_REG, RPM_MAGIC, DeltaError, Status
from .package import Package


@dataclass(frozen=True)
class PatchFile:
    name: str
    mode: int
    unpatched: bool = False
    md5: bytes = bytes(16)


@dataclass(frozen=True)
class PatchList:
    nevr: str
    files: tuple[PatchFile, ...]


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.last = data, 0, b""

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise DeltaError(Status.FORMAT, "the list is cut")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, width: int) -> int:
        return int.from_bytes(self.take(width), "big")

    def string(self) -> str:
        return self.take(self.number(1)).decode("utf-8", "replace")

    def name(self) -> str:
        """A name that keeps some of the start of the one before: kept and new lengths are a byte each, 255 stands for a wider new length of two bytes."""
        kept = self.number(1)
        size = self.number(1)
        if size == 255:
            size = self.number(2)
        self.last = self.last[:kept] + self.take(size)
        return self.last.decode("utf-8", "replace")


def parse_list(data: bytes) -> PatchList:
    r = _Reader(bytes(data))
    if r.take(4) != LIST_MAGIC:
        raise DeltaError(Status.FORMAT, "no list")
    nevr = f"{r.string()}-{r.string()}"
    r.string()  # host
    r.number(4)  # time
    out: list[PatchFile] = []
    if patches := r.number(2):
        for _ in range(patches):
            r.string()
        out += [PatchFile(r.name(), MODE_REG, True) for _ in range(r.number(4))]
    return PatchList(nevr, tuple(out + list(_records(r))))


def _records(r: _Reader) -> Iterator[PatchFile]:
    while name := r.name():
        mode, md5 = r.number(2), bytes(16)
        kind = mode & MODE_MASK
        if mode:
            bits = r.number(1)
            if bits == 255:
                owner, bits = r.number(1), r.number(1)
                r.take(owner + 1 if owner else 0)
                r.take((bits >> 2) + 1 if bits >> 2 else 0)
            else:
                for width in (bits >> 5, bits >> 2 & 7):
                    r.take(width + 1 if width else 0)
            if kind in (MODE_CHR, MODE_BLK):
                r.number(4)
            if kind in (MODE_REG, MODE_LNK) and r.number(bits % 4 + 1):
                md5 = r.take(16)
        yield PatchFile(name.removeprefix("./"), mode, md5=md5)


def read_patch_pair(rpmprint: bytes, patchrpm: bytes) -> tuple[PatchList, PatchList]:
    """Both lists; each is a list file or a package.  They must be of one package."""
    got = []
    for data in (rpmprint, patchrpm):
        if data[:4] == RPM_MAGIC:
            package = Package.parse(data, archive=False)
            got.append(PatchList(package.nevr(), tuple(PatchFile(f.name, f.mode, md5=bytes.fromhex(f.md5 or "00" * 16)[:16]) for f in package.files())))
        else:
            got.append(parse_list(data))
    if got[0].nevr != got[1].nevr:
        raise DeltaError(Status.ARGS, "the lists are of different packages")
    return got[0], got[1]


def unpatched_names(rpmprint: PatchList, patchrpm: PatchList, md5_by_name: dict[str, bytes]) -> frozenset[str]:
    """Files that the print marks as unpatched and the patch either does not list or has with another digest."""
    strip = lambda n: n.removeprefix("./").removeprefix("/")
    marked: dict[str, bool] = {}
    patched: dict[str, bytes] = {}
    for f in rpmprint.files:
        marked.setdefault(strip(f.name), f.unpatched)
    for f in patchrpm.files:
        patched.setdefault(strip(f.name), f.md5)
    return frozenset(n for n, mark in marked.items() if mark and (n not in patched or patched[n] != md5_by_name.get(n)))
