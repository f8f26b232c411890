"""Secret scans with a recursive decoding worklist.

Each text is scanned by the base patterns; then every wrapped part (percent, Unicode and string escapes, base64 at any of its four
alignments and over line breaks, and compressed data within it) is unwrapped into a layer of its own, which is scanned and
unwrapped in turn until nothing new comes up. A layer knows its places in the text it came from, so each hit leads back to a
span of the original. Decompressed data is never held whole: it is scanned in overlapping windows as it comes, and wherever a mark of
compressed data stands in it, at whatever place and depth, a decoder of its own reads on from there, member after member.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import chain
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import in_arrow

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
PERCENT = re.compile(r"%[0-7][0-9A-Fa-f]|(?:%[89A-Fa-f][0-9A-Fa-f])+")
ESCAPE = re.compile(r"(?:\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2})|\\u[0-9a-fA-F]{4}|\\x[0-7][0-9a-fA-F]|&#[xX][0-9a-fA-F]{1,6};|&#[0-9]{1,7};|\\u\{[0-9a-fA-F]{1,6}\}|\\U[0-9a-fA-F]{8}|%u[0-9a-fA-F]{4}|\\[nrt/]")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{20,}(?:\r?\n[A-Za-z0-9+/_-]+)*")
#: Lines of base64 with the same indent: all of them, or all but the first, which then is followed by a long one.
INDENTED = re.compile(r"(?m)^([ \t]+)[A-Za-z0-9+/_-]{20,}(?:\r?\n\1[A-Za-z0-9+/_-]+)+|[A-Za-z0-9+/_-]{20,}\r?\n([ \t]+)[A-Za-z0-9+/_-]{20,}(?:\r?\n\2[A-Za-z0-9+/_-]+)*")
PERCENT_BYTES = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~-]){8,}")
#: What a layer must hold for a hit or an inner layer to be possible.
PROMISING = re.compile(rb"(?i)passw|secret|token|api_?key|AKIA|[0-9a-f]{16}|[a-z0-9+/_-]{20}|%[0-9a-f]{2}|%u|\\[uxnrt/]|&#")
#: Marks of gzip, zlib, bzip2, zstandard and xz, also where they overlap; the longest has MARK bytes.
MAGIC = re.compile(rb"(?=(\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY|\x28\xb5\x2f\xfd|\xfd7zXZ\x00))", re.DOTALL)
MARK = 6
#: Characters of a window of decompressed data, and what it shares with the next one. More than the overlap is carried over where a
#: run of RUN characters would be cut, up to LONGEST of them.
WINDOW, OVERLAP, LONGEST = 1 << 20, 1 << 12, 32 << 20
#: What a decoder is given first, so that places that only look like compressed data cost little, and how deep streams may lie in each other.
FIRST, PART, DEPTH = 512, 1 << 16, 48
RUN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=%\\&#;\r\n"
SPACES = re.compile(r" {256,}")
#: Bytes that decoders may read (after their first) and yield for one text in all: a guard of time against bombs, as memory is bounded by the
#: window. A row that goes beyond it (or beyond LONGEST or DEPTH, or needs a larger decoder) says so and is not taken for clean.
MOST = 1 << 30

Span = tuple[int, int, int]  # start, place of the kind, end


def base_spans(text: str) -> list[Span]:
    """Hits of the base patterns, leftmost and non-overlapping per kind."""
    found: list[Span] = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A text with its way back: pieces (start here, start there, length there), of equal length if copied as they are."""

    __slots__ = ("text", "parent", "here", "pieces")

    def __init__(self, text: str, parent: "Layer | None" = None, pieces: list[tuple[int, int, int, bool]] | None = None):
        self.text, self.parent, self.pieces = text, parent, pieces or []
        self.here = [p[0] for p in self.pieces]

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The span of the original text that holds what stands from start to end here."""
        layer = self
        while layer.parent is not None:
            a, there, n, same = layer.pieces[bisect_right(layer.here, start) - 1]
            first = there + (start - a if same else 0)
            a, there, n, same = layer.pieces[bisect_right(layer.here, end - 1) - 1]
            start, end, layer = first, (there + (end - a) if same else there + n), layer.parent
        return start, end


def replaced(layer: Layer, pattern: re.Pattern, decode: Callable[[str], str | None]) -> Layer | None:
    """The layer with every match of an escape decoded in its place."""
    out: list[str] = []
    pieces: list[tuple[int, int, int, bool]] = []
    at = size = 0
    for m in pattern.finditer(layer.text):
        text = decode(m.group())
        if text is None or text == m.group():
            continue
        if m.start() > at:
            pieces.append((size, at, m.start() - at, True))
            out.append(layer.text[at : m.start()])
            size += m.start() - at
        if text:
            pieces.append((size, m.start(), m.end() - m.start(), False))
            out.append(text)
            size += len(text)
        at = m.end()
    if not at:
        return None
    if at < len(layer.text):
        pieces.append((size, at, len(layer.text) - at, True))
        out.append(layer.text[at:])
    return Layer("".join(out), layer, pieces) if pieces else None


def percent(escaped: str) -> str | None:
    try:
        return bytes.fromhex(escaped.replace("%", "")).decode("utf-8")
    except UnicodeDecodeError:
        return None


def is_text(raw: bytes) -> bool:
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def escape(escaped: str) -> str | None:
    try:
        if escaped.startswith("&#"):
            return chr(int(escaped[3:-1], 16) if escaped[2] in "xX" else int(escaped[2:-1]))
        if escaped in STRINGS:
            return STRINGS[escaped]
        if len(escaped) == 12:
            return bytes.fromhex(escaped.replace("\\u", "")).decode("utf-16-be")
        code = int(escaped[2:].strip("{}"), 16)
        return None if 0xD800 <= code <= 0xDFFF else chr(code)
    except (ValueError, OverflowError):
        return None


#: What programs write for line breaks, tabs and slashes within strings.
STRINGS = {"\\n": "\n", "\\r": "\r", "\\t": "\t", "\\/": "/"}


class Budget:
    """Bytes that decoders may still read and yield, and whether something was left wrapped."""

    __slots__ = ("left", "beyond")

    def __init__(self, most: int):
        self.left, self.beyond = most, False

    def spend(self, n: int) -> bool:
        """Whether that many bytes are still there; once they are not, none are."""
        self.beyond |= n > self.left
        self.left = 0 if n > self.left else self.left - n
        return not self.beyond


class Windows:
    """Bytes as they come, as overlapping windows of text, a character a byte, long runs of spaces shortened and NULs (of UTF-16) left out."""

    __slots__ = ("budget", "held")

    def __init__(self, budget: Budget):
        self.budget, self.held = budget, ""

    def feed(self, chunk: bytes) -> Iterator[str]:
        self.held = SPACES.sub(" " * 256, self.held + chunk.replace(b"\0", b"").decode("latin-1"))
        if len(self.held) >= WINDOW:
            yield self.held
            cut = min(len(self.held) - OVERLAP, len(self.held.rstrip(RUN)))
            if len(self.held) - cut > LONGEST:
                self.budget.beyond, cut = True, len(self.held) - OVERLAP
            self.held = self.held[cut:]

    def close(self) -> Iterator[str]:
        if self.held:
            yield self.held
        self.held = ""


class Stream:
    """A layer of bytes as they come: windows of its text, and those of whatever is compressed from any place in it on."""

    __slots__ = ("budget", "depth", "met", "windows", "tail", "at", "decoders", "taken")

    def __init__(self, budget: Budget, depth: int = 0, met: set[bytes] | None = None):
        self.budget, self.depth, self.windows = budget, depth, Windows(budget)
        self.met: set[bytes] = set() if met is None else met  # whole outputs that were read from somewhere in the outermost stream
        self.tail, self.at, self.decoders = b"", 0, []
        self.taken: set[int] = set()  # places that a decoder has read on over: further members of what it reads

    def feed(self, chunk: bytes, text: bool = True) -> Iterator[str]:
        if text:
            yield from self.windows.feed(chunk)
        for d in self.decoders:
            yield from d.feed(memoryview(chunk), self.at, self.taken)
        joined, base = self.tail + chunk, self.at - len(self.tail)
        for m in MAGIC.finditer(joined):
            if m.end(1) <= len(self.tail) or base + m.start() in self.taken or not may_be_data(joined, m.start()):
                continue
            if self.depth >= DEPTH or self.budget.beyond:
                self.budget.beyond = True
                break
            d = Decoder(m.group(1), self.budget, Stream(self.budget, self.depth + 1, self.met))
            yield from d.feed(memoryview(joined)[m.start() :], base + m.start(), self.taken)
            if d.alive:
                self.decoders.append(d)
        self.decoders = [d for d in self.decoders if d.alive]
        self.at, self.tail = self.at + len(chunk), joined[-MARK:]

    def close(self) -> Iterator[str]:
        for d in self.decoders:
            yield from d.close()
        yield from self.windows.close()


def may_be_data(raw: bytes, at: int) -> bool:
    """What can be told from the first bytes after a mark of gzip or zlib: their flags, and the first block's kind and length."""
    if raw[at] == 0x1F:
        return len(raw) <= at + 3 or not raw[at + 3] & 0xE0
    if raw[at] != 0x78 or len(raw) <= at + 2:
        return True
    kind = raw[at + 2] >> 1 & 3
    return kind in (1, 2) or kind == 0 and (len(raw) < at + 7 or raw[at + 3] ^ raw[at + 5] == 0xFF == raw[at + 4] ^ raw[at + 6])


class Decoder:
    """What one place of a stream decompresses to, as a stream of its own; it ends where the data are damaged or over.

    An output of up to a window is kept until it is whole. One that was met before within the outermost stream is not gone into again:
    data that unpack to themselves end, and streams that can be read along many ways are read once.
    """

    __slots__ = ("kind", "machine", "budget", "inner", "alive", "young", "pending", "held", "size")

    def __init__(self, mark: bytes, budget: Budget, inner: Stream):
        self.budget, self.inner, self.alive, self.young, self.pending = budget, inner, True, True, None
        self.held: list[bytes] | None = []
        self.size = 0
        self.renew(mark)

    def take(self, data: bytes) -> Iterator[str]:
        if self.held is None:
            yield from self.inner.feed(data)
            return
        self.held.append(data)
        self.size += len(data)
        if self.size > WINDOW:
            whole, self.held = b"".join(self.held), None
            yield from self.inner.feed(whole)

    def close(self) -> Iterator[str]:
        self.alive = False
        if self.held is not None:
            whole, self.held = b"".join(self.held), None
            mark = hashlib.blake2b(whole, digest_size=16).digest()
            if not whole or mark in self.inner.met:
                return
            self.inner.met.add(mark)
            yield from self.inner.feed(whole)
        yield from self.inner.close()

    def renew(self, mark: bytes) -> None:
        self.kind = "zlib" if mark[:1] in (b"\x1f", b"\x78") else "bz2" if mark[:1] == b"B" else "zstd" if mark[:1] == b"\x28" else "xz"
        if self.kind == "zlib":
            self.machine = zlib.decompressobj(47)
        elif self.kind == "bz2":
            self.machine = bz2.BZ2Decompressor()
        elif self.kind == "xz":
            self.machine = lzma.LZMADecompressor(memlimit=2 * LONGEST)
        else:
            import zstandard

            self.machine = zstandard.ZstdDecompressor(max_window_size=LONGEST).decompressobj()

    def outputs(self, part: memoryview) -> Iterator[bytes]:
        """What a part of the data yields, in pieces of bounded size."""
        machine = self.machine
        if self.kind == "zlib":
            yield machine.decompress(part, WINDOW)
            while machine.unconsumed_tail and not machine.eof:
                yield machine.decompress(machine.unconsumed_tail, WINDOW)
        elif self.kind == "zstd":
            yield machine.decompress(bytes(part))
        else:
            yield machine.decompress(part, WINDOW)
            while not machine.eof and not machine.needs_input:
                yield machine.decompress(b"", WINDOW)

    def feed(self, view: memoryview, place: int, taken: set[int]) -> Iterator[str]:
        """Reads on: view stands at `place` of the stream around."""
        if self.pending is not None:  # a member has ended within the last bytes before
            view, place, self.pending = memoryview(self.pending + bytes(view)), place - len(self.pending), None
            if not self.next_member(view, place, taken):
                if not self.alive:
                    yield from self.close()
                return
        at, step = 0, FIRST if self.young else PART
        while self.alive and at < len(view):
            part = view[at : at + (64 if self.kind == "zstd" else step)]  # 64 bytes hold few blocks, and a block 128 KB at most
            charged, self.young = not self.young, False
            at, step = at + len(part), PART
            try:
                for data in self.outputs(part):
                    if data:
                        if not self.budget.spend(len(data)):
                            self.alive = False
                            break
                        yield from self.take(data)
            except Exception as e:  # the libraries raise kinds of their own
                self.budget.beyond |= "memory" in str(e).lower()
                self.alive = False
            over = len(self.machine.unused_data) if self.alive and self.machine.eof else 0
            if charged and not self.budget.spend(len(part) - over):
                self.alive = False
            if self.alive and self.machine.eof:
                at, step = at - over, FIRST
                if not self.next_member(view[at:], place + at, taken):
                    break
        if not self.alive:
            yield from self.close()

    def next_member(self, view: memoryview, place: int, taken: set[int]) -> bool:
        """Whether another member of the same kind follows; it then belongs to the same data. Too few bytes to tell wait for more."""
        if len(view) <= MARK:
            self.pending = bytes(view)
            return False
        m = MAGIC.match(view)
        kind = self.kind
        if m:
            self.renew(m.group(1))
        if not m or self.kind != kind or kind == "zlib" and m.group(1)[:1] != b"\x1f":
            self.alive = False
        else:
            taken.add(place)
        return self.alive


def texts_in(raw: bytes, budget: Budget) -> Iterator[str]:
    """The texts that bytes hold: themselves, and what is compressed from any place in them on, at any depth."""
    stream = Stream(budget)
    yield from stream.feed(raw, bool(PROMISING.search(raw) or b"\0" in raw))
    yield from stream.close()


def aligned(run: str) -> Iterator[bytes]:
    """The bytes of a run of base64 characters, read from each of its first four."""
    packed = run.encode("ascii").translate(bytes.maketrans(b"-_", b"+/"), b"\r\n \t")
    for start in range(4):
        part = packed[start:]
        part = part[:-1] if len(part) % 4 == 1 else part
        yield binascii.a2b_base64(part + b"=" * (-len(part) % 4))


def unwrapped(layer: Layer, budget: Budget) -> Iterator[Layer]:
    """The layers one step inside this one, one at a time."""
    text = layer.text
    if "%" in text and (found := replaced(layer, PERCENT, percent)):
        yield found
    if ("\\" in text or "&#" in text or "%u" in text) and (found := replaced(layer, ESCAPE, escape)):
        yield found
    for m in chain(BASE64.finditer(text), INDENTED.finditer(text) if "\n " in text or "\n\t" in text else ()):
        for raw in aligned(m.group()):
            for inner in texts_in(raw, budget):
                yield Layer(inner, layer, [(0, m.start(), m.end() - m.start(), False)])
    if "%" in text:
        for m in PERCENT_BYTES.finditer(text):
            if "%" not in m.group():
                continue
            raw = unquote_to_bytes(m.group())
            if not is_text(raw):
                for inner in texts_in(raw, budget):
                    yield Layer(inner, layer, [(0, m.start(), m.end() - m.start(), False)])


def scan(text: str, most: int = MOST) -> tuple[list[Span], list[Span], int, bool]:
    """(base spans, all spans, layers met, whether something was left wrapped), in code points of the text."""
    base = base_spans(text)
    every, budget = set(base), Budget(most)
    met: set[tuple[bytes, int, int]] = set()
    todo = [unwrapped(Layer(text), budget)]
    while todo:
        layer = next(todo[-1], None)
        if layer is None:
            todo.pop()
            continue
        mark = (hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), *layer.back(0, len(layer.text)))
        if mark in met:
            continue  # this text has been met at this place: a cycle, or two ways to one layer
        met.add(mark)
        for start, kind, end in base_spans(layer.text):
            first, last = layer.back(start, end)
            every.add((first, kind, last))
        todo.append(unwrapped(layer, budget))
    return base, sorted(every), len(met), budget.beyond


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redacted(text: str, spans: list[Span], mark: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan_in_tasks(redact: str | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[list, list, list] = ([], [], [])
            digests, spans, layers, beyond, clean = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                base, every, n, big = scan(text)
                for k in range(3):
                    counts[k].append(sum(kind == k for _, kind, _ in base))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(every))
                layers.append(n)
                beyond.append(big)
                clean.append(redacted(text, every, redact) if redact is not None else None)
            arrays = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(spans), pa.array(layers, pa.int64()), pa.array(beyond, pa.bool_()), pa.array(clean, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers", "too_large", "redacted"])

    return run


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: str | None = None) -> DataFrame:
    """Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_layers, too_large, redacted for every row of docs.

    Counts and base_sha256 tell of the base hits; spans lists those and what decoding adds, in code points of the text;
    redacted is the text with every span replaced by `redact` (null if that is None). A null text is empty; repeated rows
    are each scanned; an empty table gives no rows; other columns are not read. Whole texts of any length are scanned. Narrow: no
    shuffle; a task holds a batch and a window a layer. too_large marks rows of which something was left wrapped: over 1 GB of
    what decoders read and yield, streams more than 48 deep in each other, or a wrapped run of over 32 MB within one.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return in_arrow(narrow, scan_in_tasks(redact), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, too_large boolean, redacted string")


def rewrite_in_tasks(mark: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean, whole = [], []
            for text in batch.column("text").to_pylist():
                _, every, _, beyond = ([], [], 0, False) if text is None else scan(text)
                clean.append(text if text is None else redacted(text, every, mark))
                whole.append(not beyond)
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(clean, pa.string())).filter(pa.array(whole, pa.bool_()))

    return run


def rewrite(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret of its `text` replaced by the mark; columns of any name stay, null texts stay null, repeated rows are each rewritten.

    Texts of any length are rewritten whole; an empty table gives no rows.

    All rows stay but those that find_secrets marks as too_large: what they wrap was not seen in full, so they are held back.
    """
    return in_arrow(docs, rewrite_in_tasks(mark), docs.schema)
