"""Secret scan by a recursive decoding worklist.

Each text is a first layer. A layer is scanned for secrets; then every codec (URL escapes,
Unicode escapes, base64 with optional compression below it) that finds something to unwrap
gives one more layer, in which the encoded pieces are replaced by what they hold. Where a run of
base64 begins and ends isn't known: it may be glued to a path or a word, or broken into lines. It is
tried whole, by its parts and in its four alignments; readings that overlap give layers of their own. Layers go
through a worklist until no codec yields a layer not seen before (digests of seen layers
detect cycles). A layer keeps its pieces as ranges of its parent, so that a match in any
depth is mapped back to code points of the text itself.

Packed data may have several members, may be cut short (what comes out is read) and may hold packed
data, until nothing is packed or a digest shows a cycle. What unfolds to more than `max_layer_chars` is read as
a stream, in windows that overlap, each of which is a layer of its own: memory is bounded, and no match is lost that is shorter
than the overlap. Only what is packed over and over in such streams, more than NESTED times, is left. Layers are made one at a time, depth first.

Nulls count as empty texts and have no matches; repeated rows are scanned each by itself; very long texts
are scanned whole; other columns are left alone; an empty table gives an empty one. A piece need not be text
throughout: bytes that are none are replaced or left out, and what lies between them is scanned.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import io
import lzma
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # of a maximal run: a shorter one holds no longer one
HEX = re.compile(r"[0-9a-f]{24,}")
URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\})+")
ONE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\[uUx]([0-9A-Fa-f]+)")
_B = "[A-Za-z0-9+/_-]"
_BREAK = r"(?:\r\n?|\n)[ \t]*+"
#: A run in either alphabet, also over single line breaks (with an indent).
BASE64 = re.compile(rf"(?<!{_B})(?:{_B}{{16,}}+(?:{_BREAK}{_B}++)*+|{_B}{{1,15}}+(?:{_BREAK}{_B}++)++)={{0,2}}")
#: What of a run may be encoded by itself.
PARTS = tuple(re.compile(rf"{c}{{16,}}") for c in (_B, "[A-Za-z0-9+/]", "[A-Za-z0-9_-]", "[A-Za-z0-9]"))
STANDARD = str.maketrans("-_", "+/")
#: In bytes: any match, or text that encodes one, has 12 ASCII characters at least.
ASCII = re.compile(rb"[\t\n\r\x20-\x7e]{12,}")
PACKED = re.compile(rb"\x1f\x8b|\x78[\x01\x5e\x9c\xda]|BZh|\xfd7zXZ|\x28\xb5\x2f\xfd")
SCHEMA = "n_assign bigint, n_access bigint, n_hex bigint, base_spans array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>, n_layers int"


def matches(text: str) -> list[tuple[int, int, int]]:
    """(start, end, index of the kind): leftmost, not overlapping within a kind."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return found


def _plain(c: str) -> bool:
    return c.isprintable() or c in "\t\n\r"


def readable(data: bytes) -> str | None:
    """The text in data if it is UTF-8 and mostly not control or format characters."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if text and 4 * sum(map(_plain, text)) >= 3 * len(text) else None


def legible(data: bytes) -> str | None:
    """What is text in data, of any encoding that has ASCII, other bytes replaced."""
    return data.decode("utf-8", "replace") if ASCII.search(data) else readable(data)


OVERLAP = 1 << 16
NESTED = 64


def _decoder(data: bytes):
    """A decompressor for one member: decompress(data, max_length), eof, unused_data."""
    if data.startswith(b"\x1f\x8b"):
        return zlib.decompressobj(31)
    if data[:1] == b"\x78":
        return zlib.decompressobj()
    if data.startswith(b"BZh"):
        return bz2.BZ2Decompressor()
    if data.startswith(b"\xfd7zXZ"):
        return lzma.LZMADecompressor()
    return None


def _zstd(data: bytes, most: int) -> tuple[bytes, int] | None:
    import zstandard

    out = bytearray()
    try:
        reader = zstandard.ZstdDecompressor().stream_reader(data)
        while len(out) <= most and (more := reader.read(min(1 << 20, most + 1 - len(out)))):
            out += more
    except zstandard.ZstdError:
        pass
    if not out:
        return None
    used = len(data)
    if len(out) <= most:
        try:
            d = zstandard.ZstdDecompressor().decompressobj()
            d.decompress(data)  # tells where the frame ends
            used -= len(d.unused_data)
        except zstandard.ZstdError:
            pass
    return bytes(out), used


def inflate(data: bytes, most: int, members: bool = True) -> tuple[bytes, int] | None:
    """What data holds in packed form (gzip, zlib, bzip2, xz or zstandard; all members or the first), and how many bytes of it. Of
    a member that is damaged or cut short, what comes out before. More than `most` bytes out means that there are more."""
    out, used = bytearray(), 0
    while PACKED.match(rest := data[used:]) and len(out) <= most and (members or not used):
        if rest.startswith(b"\x28\xb5\x2f\xfd"):
            if (got := _zstd(rest, most - len(out))) is None:
                break
            out += got[0]
            used += got[1]
            continue
        d, fed, before, whole = _decoder(rest), 0, len(out), False
        try:
            while not d.eof and len(out) <= most:
                tail = getattr(d, "unconsumed_tail", b"")
                part = tail or (rest[fed : fed + 65536] if getattr(d, "needs_input", True) else b"")
                fed += 0 if tail else len(part)
                more = d.decompress(part, min(1 << 20, most + 1 - len(out)))
                if not more and not part:
                    break
                out += more
            whole = d.eof
        except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError):
            pass
        if len(out) == before:
            break
        used = used + fed - len(d.unused_data) if whole else len(data)
    return (bytes(out), used) if out else None


def raw_inflate(data: bytes, most: int) -> bytes | None:
    """What a whole deflate stream without a header holds; only a stream that ends with the data is taken for one."""
    d = zlib.decompressobj(-15)
    try:
        out = d.decompress(data, most + 1)
    except zlib.error:
        return None
    return out if out and (d.eof or len(out) > most) and not d.unused_data else None


class _Unfolding(io.RawIOBase):
    """A stream of what packed bytes hold, for those codecs whose own streams don't read on behind damage."""

    def __init__(self, source, first: bytes):
        self.source, self.d = source, zlib.decompressobj(-15) if first == b"raw" else _decoder(first)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.d.eof:
            tail = getattr(self.d, "unconsumed_tail", b"")
            part = tail or (self.source.read(65536) if getattr(self.d, "needs_input", True) else b"")
            try:
                more = self.d.decompress(part, len(into))
            except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError):
                return 0
            if more:
                into[: len(more)] = more
                return len(more)
            if not part:
                return 0
        first = self.d.unused_data + self.source.read(65536)
        if not PACKED.match(first) or (d := _decoder(first)) is None:
            return 0
        self.d, self.source = d, io.BufferedReader(_Joined(first, self.source))
        return self.readinto(into)


class _Joined(io.RawIOBase):
    def __init__(self, first: bytes, source):
        self.first, self.source = first, source

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        part = self.first[: len(into)] or self.source.read(len(into))
        self.first = self.first[len(part) :]
        into[: len(part)] = part
        return len(part)


def windows(data: bytes, most: int, raw: bool = False):
    """Texts of what data holds, unpacked as a stream, in windows of `most` bytes that overlap."""
    stream = io.BufferedReader(io.BytesIO(data))
    for depth in range(NESTED):
        first = stream.peek(8)[:8]
        if first.startswith(b"\x28\xb5\x2f\xfd"):
            import zstandard

            stream = io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(stream, read_across_frames=True))
        elif PACKED.match(first) or (raw and not depth):
            stream = io.BufferedReader(_Unfolding(stream, first if PACKED.match(first) else b"raw"))
        else:
            break
    held = b""
    while True:
        more = b""
        try:
            while len(more) < most and (part := stream.read(min(1 << 20, most - len(more)))):
                more += part
        except Exception as e:  # zstandard's own error class, which is not imported at the top
            if type(e).__name__ != "ZstdError":
                raise
        if more and (text := legible(held + more)) is not None:
            yield text
        if len(more) < most:
            return
        held = more[-OVERLAP:]


def unpacked(data: bytes, most: int) -> bytes | None:
    """What data holds when nothing is packed any more; None if that is more than `most` bytes."""
    seen = set()
    while PACKED.match(data) and (key := hashlib.blake2b(data, digest_size=16).digest()) not in seen:
        seen.add(key)
        if (inner := inflate(data, most)) is None:
            break
        if len(inner[0]) > most:
            return None
        data = inner[0]
    return data


def unpackable(data: bytes, most: int) -> bool:
    return PACKED.match(data) is not None and inflate(data, most) is not None


def url_pieces(text: str, most: int):
    """(start, end, what it holds) for each escaped run, a character a piece; bytes that are not
    UTF-8 stay escaped."""
    for m in URL.finditer(text):
        at = m.start()
        for c in bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape"):
            if "\udc80" <= c <= "\udcff":
                at += 3
                continue
            width = 3 * len(c.encode())
            yield at, at + width, c
            at += width


def unicode_pieces(text: str, most: int):
    for m in UNICODE.finditer(text):
        high = None
        for x in ONE.finditer(text, m.start(), m.end()):
            code = int(x[1] or x[2], 16)
            if 0xD800 <= code < 0xDC00:
                high = (x.start(), code)
            elif 0xDC00 <= code < 0xE000:
                if high:
                    yield high[0], x.end(), chr(0x10000 + ((high[1] - 0xD800) << 10) + code - 0xDC00)
                high = None
            elif code <= 0x10FFFF:
                high = None
                yield x.start(), x.end(), chr(code)


def decoded(chars: str) -> bytes:
    """Of either alphabet, without padding; a last character that completes no byte is left out."""
    chars = chars[: len(chars) - (len(chars) % 4 == 1)]
    return binascii.a2b_base64(chars.translate(STANDARD) + "=" * (-len(chars) % 4))


def stretches(data: bytes, most: int):
    """(start, end, what it holds) of packed data and of text anywhere in data. What is too long for one layer
    is a function that gives its windows."""
    at = 0
    if not PACKED.match(data) and (out := raw_inflate(data, most)) is not None:
        if len(out) > most or (inner := unpacked(out, most)) is None:
            yield 0, len(data), lambda: windows(data, most, raw=True)
        elif ASCII.search(inner):
            yield 0, len(data), legible(inner)
    joined = 0
    while m := PACKED.search(data, at):
        at = m.end()
        if (inner := inflate(data[m.start() :], most, members=False)) is None:
            continue
        end = max(at, m.start() + inner[1])
        if len(inner[0]) > most or (whole := unpacked(inner[0], most)) is None:
            yield m.start(), len(data), lambda start=m.start(): windows(data[start:], most)
            continue
        if (held := legible(whole)) is not None:
            at = end
            yield m.start(), end, held
        if m.start() >= joined and PACKED.match(data, end) and (several := inflate(data[m.start() :], most)) is not None:
            joined = max(end, m.start() + several[1])  # members one behind another hold one text
            if len(several[0]) > most or (whole := unpacked(several[0], most)) is None:
                yield m.start(), len(data), lambda start=m.start(): windows(data[start:], most)
            elif (held := legible(whole)) is not None:
                yield m.start(), joined, held
    for m in ASCII.finditer(data):
        yield m.start(), m.end(), m[0].decode("ascii")


def run_pieces(m: re.Match, most: int):
    """(start, end, what it holds) for a run of BASE64, which may overlap: the run whole; else those
    of its parts that are text by themselves, and the text and packed data in its four alignments."""
    run, shift = m[0].rstrip("="), m.start()
    chars = "".join(run.split())
    if len(chars) < 16:
        return
    places = range(len(run)) if len(chars) == len(run) else [k for k, c in enumerate(run) if not c.isspace()]
    ends = lambda k: m.end() if k == len(run) else shift + k  # noqa: E731  (with the padding)
    known = bytearray(len(run))  # 1 + the alignment in which a character is in a part that is text
    if len(chars) % 4 != 1 and (held := readable(data := decoded(chars))) is not None and not unpackable(data, most):
        yield shift, m.end(), held
        if all(map(_plain, held)):
            return
        known = bytearray(b"\1") * len(run)
    for part in PARTS:
        for x in part.finditer(run):
            if x[0] == run or known[x.start()] or len(x[0]) % 4 == 1:
                continue
            if (held := readable(data := decoded(x[0]))) is not None and not unpackable(data, most):
                known[x.start() : x.end()] = bytes([1 + bisect_left(places, x.start()) % 4]) * len(x[0])
                yield shift + x.start(), ends(x.end()), held
    for k in range(4):
        for a, b, held in stretches(decoded(chars[k:]), most):
            start, end = places[k + a * 4 // 3], places[k - (-b * 4 // 3) - 1] + 1
            if not known[start] == known[end - 1] == k + 1:
                yield shift + start, ends(end), held


def base64_layers(text: str, most: int):
    """Lists of pieces; a piece that overlaps another of its run is in a further list, and so is each window of what
    is read as a stream."""
    layers: list[list[tuple[int, int, str]]] = []
    streams = []
    for m in BASE64.finditer(text):
        for piece in run_pieces(m, most):
            if callable(piece[2]):
                streams.append(piece)
                continue
            for own in layers:
                at = bisect_left(own, piece)
                if (at == 0 or own[at - 1][1] <= piece[0]) and (at == len(own) or piece[1] <= own[at][0]):
                    insort(own, piece)
                    break
            else:
                layers.append([piece])
    yield from layers
    for start, end, texts in streams:
        for held in texts():
            yield [(start, end, held)]


class Layer:
    """A decoded text; pieces maps its ranges to ranges of the parent."""

    __slots__ = ("parent", "pieces", "starts", "text")

    def __init__(self, text: str, parent: Layer | None = None, pieces: list | None = None):
        self.text, self.parent, self.pieces = text, parent, pieces or []
        self.starts = [p[0] for p in self.pieces]

    def unwrap(self, found) -> Layer | None:
        parts, pieces, at, there = [], [], 0, 0
        for start, end, held in found:
            if start > at:
                parts.append(self.text[at:start])
                pieces.append((there, start - at, at, start, False))
                there += start - at
            parts.append(held)
            pieces.append((there, len(held), start, end, True))
            there += len(held)
            at = end
        if not pieces:
            return None
        if at < len(self.text):
            parts.append(self.text[at:])
            pieces.append((there, len(self.text) - at, at, len(self.text), False))
        return Layer("".join(parts), self, pieces)

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The range of the first layer that holds [start, end) of this one."""
        layer = self
        while layer.parent is not None:
            t, _, a, _, packed = layer.pieces[bisect_right(layer.starts, start) - 1]
            t2, _, a2, b2, packed2 = layer.pieces[bisect_right(layer.starts, end - 1) - 1]
            start = a if packed else a + start - t
            end = b2 if packed2 else a2 + end - t2
            layer = layer.parent
        return start, end


def scan(text: str | None, max_layer_chars: int = 16 << 20) -> tuple[list, list, int]:
    """Base matches, all matches (both sorted by start, kind, end) and the number of layers."""
    text = text or ""
    base = sorted(matches(text), key=lambda x: (x[0], x[2], x[1]))
    every = set(base)
    if "%" not in text and "\\" not in text and not BASE64.search(text):
        return base, base, 1
    seen, n = {hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()}, 0

    def inner(layer: Layer):
        """The layers below, one at a time."""
        for pieces in chain((url_pieces(layer.text, max_layer_chars), unicode_pieces(layer.text, max_layer_chars)), base64_layers(layer.text, max_layer_chars)):
            found = layer.unwrap(pieces)
            if found is not None:
                digest = hashlib.blake2b(found.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                if digest not in seen:
                    seen.add(digest)
                    yield found

    work = [iter([Layer(text)])]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        n += 1
        if layer.parent is not None:
            every |= {(*layer.back(s, e), k) for s, e, k in matches(layer.text)}
        work.append(inner(layer))
    return base, sorted(every, key=lambda x: (x[0], x[2], x[1])), n


def _spans(found: list[list[tuple]]) -> pa.Array:
    lengths = [0]
    for x in found:
        lengths.append(lengths[-1] + len(x))
    rows = [y for x in found for y in x]
    items = pa.StructArray.from_arrays([pa.array([KINDS[k] for _, _, k in rows], pa.string()), pa.array([s for s, _, _ in rows], pa.int32()), pa.array([e for _, e, _ in rows], pa.int32())], ["kind", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), items)


def findings(text: Column | str, max_layer_chars: int = 16 << 20) -> Column:
    """A struct of counts of the base kinds, base spans, all spans and the number of layers."""

    @arrow_udf(SCHEMA)
    def found(column: pa.Array) -> pa.Array:
        bases, every, layers = [], [], []
        for t in column:
            b, a, n = scan(t.as_py(), max_layer_chars)
            bases.append(b)
            every.append(a)
            layers.append(n)
        counts = [pa.array([sum(k == kind for _, _, k in b) for b in bases], pa.int64()) for kind in range(3)]
        return pa.StructArray.from_arrays([*counts, _spans(bases), _spans(every), pa.array(layers, pa.int32())], ["n_assign", "n_access", "n_hex", "base_spans", "spans", "n_layers"])

    return found(text)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of a secret in text_col (overlaps merged) replaced by mark.
    Nulls stay null."""

    @arrow_udf("string")
    def cleaned(column: pa.Array) -> pa.Array:
        out = []
        for t in column:
            text = t.as_py()
            _, every, _ = scan(text)
            if every:
                parts, at, until = [], 0, -1
                for s, e, _k in every:
                    if s > until:
                        if until >= 0:
                            at = until
                        parts += [text[at:s], mark]
                    until = max(until, e)
                text = "".join(parts) + text[until:]
            out.append(text)
        return pa.array(out, pa.string())

    return docs.withColumn(text_col, cleaned(F.col(text_col)))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id and what `findings` has."""
    return docs.select(F.col(id_col), findings(F.col(text_col)).alias("_f")).select(id_col, "_f.*")
