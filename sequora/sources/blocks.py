"""Byte access for the splittable readers: files of any store, BGZF blocks, lines with owners.

A file is read by byte ranges [start, stop). Whatever begins in a range belongs to it: a block
by its first byte, a line by the newline before it (so a reader that lands in the middle of a
line knows without looking back). The reader of a range reads past its stop only to finish
what began inside.
"""

from __future__ import annotations

import glob
import os
import zlib
from collections import deque
from collections.abc import Iterator

MAGIC = b"\x1f\x8b\x08\x04"
WIDEST = 1 << 16
#: Fixed value: the empty block that ends a BGZF file.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


# Files of a store ----------------------------------------------------------------


def _resolved(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def opened(path: str):
    """A seekable file, local or of any store that pyarrow reaches."""
    store, inner = _resolved(path)
    return store.open_input_file(inner)


def created(path: str):
    store, inner = _resolved(path)
    store.create_dir(os.path.dirname(inner), recursive=True)
    return store.open_output_stream(inner, compression=None)


def removed(path: str) -> None:
    from pyarrow import fs

    store, inner = _resolved(path)
    if store.get_file_info(inner).type != fs.FileType.NotFound:
        store.delete_file(inner)


def listed(path: str, skip: tuple[str, ...] = ()) -> list[tuple[str, int]]:
    """(path, bytes) of the files at ``path``: one file, a folder's, or those of a local pattern."""
    from pyarrow import fs

    store, inner = _resolved(path)
    if isinstance(store, fs.LocalFileSystem) and glob.has_magic(inner):
        found = store.get_file_info(sorted(glob.glob(inner)))
    else:
        found = [store.get_file_info(inner)]
        if found[0].type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if found[0].type == fs.FileType.Directory:
            found = sorted(store.get_file_info(fs.FileSelector(inner)), key=lambda f: f.path)
    prefix = path.partition("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""
    return [(prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")) and not f.base_name.endswith(skip or ("\0",))]


def ranges(size: int, most: int) -> list[tuple[int, int]]:
    """Byte ranges of about equal length, ``most`` at the longest, that cover a file."""
    parts = max(1, -(-size // most))
    cuts = [size * i // parts for i in range(parts + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


# BGZF ----------------------------------------------------------------------------


def block_size(head: bytes) -> int:
    """Bytes of the BGZF block that ``head`` begins, 0 if it begins none."""
    if head[:4] != MAGIC or len(head) < 18:
        return 0
    at, stop = 12, 12 + int.from_bytes(head[10:12], "little")
    while at + 6 <= min(stop, len(head)):
        length = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == b"BC" and length == 2:
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + length
    return 0


def bgzf_block(data: bytes, level: int = 6) -> bytes:
    """One block of at most 65 280 bytes of content."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    if len(body) + 26 > WIDEST:
        return bgzf_block(data, 0)
    head = MAGIC + b"\0\0\0\0\0\xff\6\0BC\2\0" + (len(body) + 25).to_bytes(2, "little")
    return head + body + zlib.crc32(data).to_bytes(4, "little") + len(data).to_bytes(4, "little")


class BgzfWriter:
    """Writes content as BGZF blocks; ``place`` is the virtual offset of the next byte."""

    def __init__(self, file, block: int = 65_000):
        self.file, self.block, self.held, self.written = file, block, bytearray(), 0

    @property
    def place(self) -> int:
        return self.written << 16 | len(self.held)

    def write(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= self.block:
            self._flush(self.block)

    def _flush(self, n: int) -> None:
        made = bgzf_block(bytes(self.held[:n]))
        self.file.write(made)
        self.written += len(made)
        del self.held[:n]

    def close(self) -> None:
        if self.held:
            self._flush(len(self.held))
        self.file.write(END)
        self.file.close()


class Inflated:
    """The content of a BGZF file from a block on; knows in which block each byte lies."""

    def __init__(self, file, at: int = 0):
        self.file, self.size = file, file.size()
        self.next, self.base, self.data = at, 0, bytearray()
        self.marks: deque[tuple[int, int]] = deque()  # (place in the content, offset of the block)

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def find(self, at: int) -> int:
        """The first block at ``at`` or later; one counts if another, or the end, follows it."""
        while at < self.size:
            window = self.read(at, 2 * WIDEST)
            p = window.find(MAGIC)
            while p >= 0:
                n = block_size(window[p : p + 300]) or block_size(self.read(at + p, 300))
                if n and (at + p + n == self.size or block_size(self.read(at + p + n, 300))):
                    return at + p
                p = window.find(MAGIC, p + 1)
            at += max(1, len(window) - 3) if len(window) == 2 * WIDEST else len(window)
        return self.size

    def more(self) -> bool:
        """Inflate the next block; False at the end of the file, or where it breaks off."""
        head = self.read(self.next, WIDEST) if self.next < self.size else b""
        n = block_size(head)
        if not n or n > len(head):
            return False
        self.marks.append((self.base + len(self.data), self.next))
        self.data += zlib.decompressobj(31).decompress(head[:n])
        self.next += n
        return True

    def has(self, place: int) -> bool:
        """Whether the content reaches ``place``; inflates as far."""
        while self.base + len(self.data) < place:
            if not self.more():
                return False
        return True

    def bytes(self, place: int, n: int) -> bytes:
        return bytes(self.data[place - self.base : place - self.base + n])

    def block_of(self, place: int) -> int:
        """The offset of the block that holds ``place``; places asked for must not go back."""
        while len(self.marks) > 1 and self.marks[1][0] <= place:
            self.marks.popleft()
        return self.marks[0][1]

    def forget(self, place: int) -> None:
        """Free what lies before ``place``, now and then."""
        if place - self.base > 1 << 20:
            del self.data[: place - self.base]
            self.base = place


# Lines ---------------------------------------------------------------------------


def lines(file, start: int, stop: int) -> Iterator[tuple[bool, bytes]]:
    """(begins in [start, stop), line without its end) from the first line that begins in the range on.

    Works on plain text, BGZF, and gzip that is not in blocks, which is one range.
    """
    head = file.read(300)
    if block_size(head):
        yield from _block_lines(file, start, stop)
    elif head[:2] == b"\x1f\x8b":
        if start == 0:
            yield from ((True, line) for line in _whole_lines(file))
    else:
        yield from _plain_lines(file, start, stop, min(1 << 20, max(1 << 12, stop - start)))


def _plain_lines(file, start: int, stop: int, step: int = 1 << 20) -> Iterator[tuple[bool, bytes]]:
    file.seek(start)
    held, place, skip = b"", start, start > 0
    while True:
        part = file.read(step)
        held += part
        *found, rest = held.split(b"\n")
        for line in found:
            if not skip:
                yield place - 1 < stop, line.removesuffix(b"\r")
            skip, place = False, place + len(line) + 1
        held = rest
        if not part:
            if held and not skip:
                yield place - 1 < stop, held.removesuffix(b"\r")
            return


def _block_lines(file, start: int, stop: int) -> Iterator[tuple[bool, bytes]]:
    content = Inflated(file)
    content.next = content.find(start) if start else 0
    place, seen, skip, owner = 0, 0, start > 0, 0 if not start else None
    while True:
        end = content.data.find(b"\n", seen - content.base)
        if end < 0:
            seen = content.base + len(content.data)
            if content.more():
                continue
            if seen > place and not skip:
                yield owner < stop, content.bytes(place, seen - place).removesuffix(b"\r")
            return
        end += content.base
        if not skip:
            yield owner < stop, content.bytes(place, end - place).removesuffix(b"\r")
        skip, place, seen, owner = False, end + 1, end + 1, content.block_of(end)
        content.forget(place)


def _whole_lines(file, step: int = 1 << 20) -> Iterator[bytes]:
    file.seek(0)
    unpack, held = zlib.decompressobj(31), b""
    while part := file.read(step):
        while part:
            held += unpack.decompress(part)
            part = unpack.unused_data
            if unpack.eof:
                unpack = zlib.decompressobj(31)
        *found, held = held.split(b"\n")
        yield from (line.removesuffix(b"\r") for line in found)
    if held:
        yield held.removesuffix(b"\r")
