"""Column chunks as bytes: copied from files or freshly encoded, put together to row groups and files with footers written anew.

Nothing is decoded. A chunk keeps its pages; only its offsets move. Bloom filters stay where they lie inside the bytes copied; page indexes and index
pages, which lie outside, are dropped from the footer, as Parquet allows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import groupby

from . import thrift
from .footer import MAGIC, FooterError, chunk_start, parse_footer
from .stores import Range, StoreError, opened
from .thrift import I16, I32, I64, LIST, STRUCT, Typed

# Field numbers of a Parquet footer. File: schema, rows, row groups, key/value pairs, creator.
SCHEMA, ROWS, GROUPS, PAIRS, CREATOR = 2, 3, 4, 5, 6
# Row group: columns, bytes, rows, offset, compressed bytes, ordinal. Sorting columns (4) stay as they are.
G_COLUMNS, G_BYTES, G_ROWS, G_OFFSET, G_COMPRESSED, G_ORDINAL = 1, 2, 3, 5, 6, 7
# Column chunk: path, offset, metadata, page indexes.
C_PATH, C_OFFSET, C_META, C_INDEXES = 1, 2, 3, (4, 5, 6, 7)
# Metadata of a chunk.
M_NAME, M_VALUES, M_PLAIN_BYTES, M_BYTES, M_DATA, M_INDEX_PAGE, M_DICTIONARY, M_BLOOM, M_BLOOM_BYTES = 3, 5, 6, 7, 9, 10, 11, 14, 15


class ChunkError(ValueError):
    """Chunks that don't make a row group, or row groups that don't make a file."""


@dataclass(frozen=True)
class Chunk:
    """One column chunk: where its bytes are and its footer entry. ``rows`` are the rows of its row group."""

    column: str
    rows: int
    entry: bytes
    source: Range | bytes

    @property
    def start(self) -> int:
        m = self._typed[C_META][1]
        return chunk_start(_of(m, M_DICTIONARY), m[M_DATA][1])

    @property
    def length(self) -> int:
        return self._typed[C_META][1][M_BYTES][1]

    @property
    def _typed(self) -> Typed:
        return thrift.parse(self.entry)[0]

    def read(self) -> bytes:
        return self.source if isinstance(self.source, bytes) else self.source.read()

    def moved(self, start: int, span: tuple[int, int] | None = None) -> Typed:
        """The footer entry of the chunk where it begins at ``start``; ``span`` are the source's bytes that move along with it."""
        entry = self._typed
        by, meta = start - self.start, dict(entry[C_META][1])
        meta[M_DATA] = I64, meta[M_DATA][1] + by
        if M_DICTIONARY in meta:
            at = meta[M_DICTIONARY][1]
            meta[M_DICTIONARY] = I64, at + by if at > 0 else at
        meta.pop(M_INDEX_PAGE, None)
        low, high = span or (self.start, self.start + self.length)
        if M_BLOOM in meta and not low <= meta[M_BLOOM][1] < high:
            meta.pop(M_BLOOM), meta.pop(M_BLOOM_BYTES, None)
        elif M_BLOOM in meta:
            meta[M_BLOOM] = I64, meta[M_BLOOM][1] + by
        kept = {n: f for n, f in entry.items() if n not in (C_PATH, *C_INDEXES)}
        return kept | {C_OFFSET: (I64, start), C_META: (STRUCT, meta)}


def _of(fields: Typed, number: int):
    return fields[number][1] if number in fields else None


def file_footer(path: str) -> tuple[Typed, int]:
    """(footer, its offset) of one file."""
    with opened(path) as f:
        raw, at = parse_footer(f.size(), lambda a, n: f.read_at(n, a))
    return thrift.parse(raw)[0], at


def file_head(path: str) -> Typed:
    """The footer of one file without its row groups."""
    with opened(path) as f:
        raw, _ = parse_footer(f.size(), lambda a, n: f.read_at(n, a))
    return thrift.split_list(raw, GROUPS)[0]


def chunks_of(path: str, group: Typed) -> list[Chunk]:
    """The chunks of a row group, given its footer entry, in column order."""
    out = []
    for column in group[G_COLUMNS][1][1]:
        m = column[C_META][1]
        start = chunk_start(_of(m, M_DICTIONARY), m[M_DATA][1])
        name = b".".join(m[M_NAME][1][1]).decode()
        out.append(Chunk(name, group[G_ROWS][1], thrift.dump(column), Range(path, start, m[M_BYTES][1])))
    return out


def group_chunks(path: str, footer: Typed, group: int) -> list[Chunk]:
    """The chunks of one row group of a file, in column order."""
    groups = footer[GROUPS][1][1] if GROUPS in footer else []
    if not 0 <= group < len(groups):
        raise FooterError(f"{path} has no row group {group}")
    return chunks_of(path, groups[group])


def file_chunk(path: str, group: int, column: str) -> Chunk:
    """One chunk of a file; its bytes can be opened again and again (``chunk.source.open()``).

    Its file's footer is read anew each time: for many chunks take the relations ``group_entries`` and ``chunk_entries``, which read it once.
    """
    with opened(path) as f:
        raw, _ = parse_footer(f.size(), lambda a, n: f.read_at(n, a))
    spans = thrift.split_list(raw, GROUPS)[1]
    if not 0 <= group < len(spans):
        raise FooterError(f"{path} has no row group {group}")
    found = next((c for c in chunks_of(path, thrift.parse(raw, spans[group][0])[0]) if c.column == column), None)
    if found is None:
        raise FooterError(f"{path} has no column {column}")
    return found


def entries_of(path: str, raw: bytes, data_end: int, relation: str) -> Iterator[tuple]:
    """Rows of the footer relations ``group_entries``, ``chunk_entries`` and ``schemas``; one row group is parsed at a time."""
    base, spans = thrift.split_list(raw, GROUPS)
    if relation == "schemas":
        yield path, thrift.dump({SCHEMA: base[SCHEMA]})
        return
    head = thrift.dump(base)
    for i, (a, b) in enumerate(spans):
        group = chunks_of(path, thrift.parse(raw, a)[0])
        if relation == "group_entries":
            low, high = min(c.source.start for c in group), max(c.source.start + c.source.length for c in group)
            yield path, i, low, high - low, group[0].rows, data_end, head, raw[a:b]
            continue
        for c in group:
            yield path, i, c.column, c.source.start, c.source.length, c._typed[C_META][1][M_VALUES][1], c.rows, c.entry


def read_each(chunks: Iterable[Chunk]) -> Iterator[bytes]:
    """Bytes of chunks of files in their order; a file is opened once for those of it that follow each other."""
    for path, members in groupby(chunks, key=lambda c: c.source.path):
        with opened(path) as f:
            size = f.size()
            for c in members:
                if c.source.start + c.source.length > size:
                    raise StoreError(f"{path}: bytes {c.source.start} to {c.source.start + c.source.length} lie beyond the end of {size}")
                yield f.read_at(c.source.length, c.source.start)


def encoded(table, **options) -> tuple[Typed, list[Chunk]]:
    """(footer, chunks) of an Arrow table encoded as one row group in memory."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    if table.num_rows == 0:
        raise ChunkError("a chunk has at least one value")
    sink = pa.BufferOutputStream()
    pq.write_table(table, sink, row_group_size=table.num_rows, **options)
    content = sink.getvalue().to_pybytes()
    raw, _ = parse_footer(len(content), lambda a, n: content[a : a + n])
    footer = thrift.parse(raw)[0]
    made = group_chunks("", footer, 0)
    return footer, [replace(c, source=content[c.start : c.start + c.length]) for c in made]


def fresh_chunk(column, *, codec: str = "zstd", **options) -> Chunk:
    """A chunk newly encoded from an Arrow column (a table of one column), to stand beside copied ones."""
    return encoded(column, compression=codec, **options)[1][0]


def fresh_schema(table) -> list[Typed]:
    """Schema elements of an Arrow table's columns, to stand beside those of a file."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    sink = pa.BufferOutputStream()
    pq.write_table(table.slice(0, 0), sink)
    content = sink.getvalue().to_pybytes()
    raw, _ = parse_footer(len(content), lambda a, n: content[a : a + n])
    return thrift.parse(raw)[0][SCHEMA][1][1][1:]


def pairs_of(footer: Typed) -> list[tuple[str, str]]:
    """Key/value pairs in their order, repeated keys included."""
    found = footer[PAIRS][1][1] if PAIRS in footer else []
    return [(p[1][1].decode("utf-8", "replace"), p[2][1].decode("utf-8", "replace") if 2 in p else "") for p in found]


def page_headers(data: bytes) -> list[tuple[str, int, int]]:
    """(kind, values, bytes with header) of every page of a chunk's bytes; kinds are ``dictionary``, ``v1`` and ``v2``."""
    out, at = [], 0
    while at < len(data):
        head, end = thrift.parse(data, at)
        # Field numbers of a page header (compressed size, then the headers by kind); the number of values comes first in each.
        size = head[3][1]
        kind = next((k, n) for k, n in (("v1", 5), ("dictionary", 7), ("v2", 8)) if n in head)
        out.append((kind[0], head[kind[1]][1][1][1], end - at + size))
        at = end + size
    return out


class GroupBuilder:
    """Collects the chunks of one row group: each column once, all with the same number of rows, none missing at the end."""

    def __init__(self, columns: Sequence[str]):
        self.columns, self.chunks = list(columns), {}

    def add(self, chunk: Chunk) -> GroupBuilder:
        if chunk.column not in self.columns:
            raise ChunkError(f"column {chunk.column} isn't in the schema")
        if chunk.column in self.chunks:
            raise ChunkError(f"column {chunk.column} was added already")
        rows = next((c.rows for c in self.chunks.values()), chunk.rows)
        if rows != chunk.rows:
            raise ChunkError(f"column {chunk.column} has {chunk.rows} rows, the row group has {rows}")
        self.chunks[chunk.column] = chunk
        return self

    def build(self) -> list[Chunk]:
        if missing := [c for c in self.columns if c not in self.chunks]:
            raise ChunkError(f"columns are missing: {', '.join(missing)}")
        return [self.chunks[c] for c in self.columns]

    @property
    def num_bytes(self) -> int:
        return sum(c.length for c in self.chunks.values())


def group_entry(chunks: Sequence[Chunk], start: int, ordinal: int) -> Typed:
    """Footer entry of a row group whose chunks lie one behind the other from ``start`` on."""
    entries, at = [], start
    for c in chunks:
        entries.append(c.moved(at))
        at += c.length
    return group_of_entries(entries, chunks[0].rows, ordinal)


def group_of_entries(entries: Sequence[Typed], rows: int, ordinal: int) -> Typed:
    """Footer entry of a row group from those of its chunks, which have their places already."""
    plain, held = (sum(e[C_META][1][n][1] for e in entries) for n in (M_PLAIN_BYTES, M_BYTES))
    start = entries[0][C_OFFSET][1]
    return {G_COLUMNS: (LIST, (STRUCT, list(entries))), G_BYTES: (I64, plain), G_ROWS: (I64, rows), G_OFFSET: (I64, start), G_COMPRESSED: (I64, held), G_ORDINAL: (I16, ordinal)}


def schema_of(footer: Typed, columns: Sequence[str] | None = None, more: Iterable[Typed] = ()) -> list[Typed]:
    """Schema elements of a flat footer: the root and the chosen columns in their order (from ``footer`` and ``more``)."""
    root, *elements = footer[SCHEMA][1][1]
    by_name = {e[4][1].decode(): e for e in [*elements, *more]}
    names = list(by_name) if columns is None else list(columns)
    if unknown := [c for c in names if c not in by_name]:
        raise ChunkError(f"no such columns: {', '.join(unknown)}")
    return [root | {5: (I32, len(names))}, *[by_name[c] for c in names]]


def footer_bytes(base: Typed, groups: Sequence[Typed | bytes], *, schema: Sequence[Typed] | None = None, pairs: Sequence[tuple[str, str]] | None = None, rows: int | None = None) -> bytes:
    """Footer, its length and the closing magic, from another file's footer with other row groups (and schema, and key/value pairs).

    Row groups may be given as bytes, then with the ``rows`` of all.
    """
    if not groups:
        raise ChunkError("a file without row groups can't be written")
    out = {n: f for n, f in base.items() if n not in (7,) or schema is None}  # column orders go by the schema
    out |= {ROWS: (I64, sum(g[G_ROWS][1] for g in groups) if rows is None else rows), GROUPS: (LIST, (STRUCT, list(groups)))}
    if schema is not None:
        out[SCHEMA] = LIST, (STRUCT, list(schema))
        out.pop(PAIRS, None)  # a writer's own copy of the schema would no longer fit
    if pairs is not None:
        out[PAIRS] = LIST, (STRUCT, [{1: (thrift.BINARY, k.encode()), 2: (thrift.BINARY, v.encode())} for k, v in pairs])
    raw = thrift.dump(out)
    return raw + struct.pack("<I", len(raw)) + MAGIC


def assembled(base: Typed, groups: Sequence[Sequence[Chunk]], *, schema: Sequence[Typed] | None = None, pairs: Sequence[tuple[str, str]] | None = None) -> bytes:
    """A file of these row groups, in memory; its length is checked against the one computed from the chunks."""
    at, entries, out = len(MAGIC), [], [MAGIC]
    for i, chunks in enumerate(groups):
        entries.append(group_entry(chunks, at, i))
        out += [c.read() for c in chunks]
        at += sum(c.length for c in chunks)
    tail = footer_bytes(base, entries, schema=schema, pairs=pairs)
    content = b"".join([*out, tail])
    if len(content) != at + len(tail):
        raise ChunkError(f"{len(content)} bytes were put together, not the {at + len(tail)} computed")
    return content


def moved_groups(path: str, by: int) -> tuple[list[bytes], bytes, int]:
    """(footer entries, page indexes, rows) of a file whose data moves ``by`` bytes; entries name places of indexes from the beginning of those bytes on."""
    with opened(path) as f:
        raw, _ = parse_footer(f.size(), lambda a, n: f.read_at(n, a))
        _, spans = thrift.split_list(raw, GROUPS)
        out, index, rows = [], bytearray(), 0
        for a, _ in spans:
            group = thrift.parse(raw, a)[0]
            columns = []
            for c, old in zip(chunks_of(path, group), group[G_COLUMNS][1][1], strict=True):
                entry = c.moved(c.source.start + by)
                for place, length in ((6, 7), (4, 5)):  # column index as it is, offset index with its pages' places moved
                    if place in old and length in old:
                        held = f.read_at(old[length][1], old[place][1])
                        if place == 4:
                            held = _moved_pages(held, by)
                        entry |= {place: (I64, len(index)), length: (I32, len(held))}
                        index += held
                columns.append(entry)
            moved = group | {G_COLUMNS: (LIST, (STRUCT, columns))}
            if G_OFFSET in group:
                moved[G_OFFSET] = I64, group[G_OFFSET][1] + by
            out.append(thrift.dump(moved))
            rows += group[G_ROWS][1]
    return out, bytes(index), rows


def _moved_pages(index: bytes, by: int) -> bytes:
    """An offset index (list of page places, offset first) whose pages move ``by`` bytes."""
    fields = thrift.parse(index)[0]
    of, pages = fields[1][1]
    return thrift.dump(fields | {1: (LIST, (of, [p | {1: (I64, p[1][1] + by)} for p in pages]))})


def placed_group(entry: bytes, index_start: int, ordinal: int) -> bytes:
    """An entry of ``moved_groups`` whose page indexes begin at ``index_start``, with its ordinal in the file."""
    group = thrift.parse(entry)[0]
    for c in group[G_COLUMNS][1][1]:
        for place in (4, 6):
            if place in c:
                c[place] = I64, c[place][1] + index_start
    group.pop(G_ORDINAL, None)
    return thrift.dump(group | ({G_ORDINAL: (I16, ordinal)} if ordinal < 1 << 15 else {}))


def split_group(path: str, footer: Typed, group: int, data_end: int | None = None) -> bytes:
    """A file of one row group alone: its bytes as they lie, behind a magic, with a footer whose offsets have moved along.

    ``data_end`` is where the file's data ends (its footer begins); a row group that reaches beyond is an error.
    """
    groups = footer[GROUPS][1][1] if GROUPS in footer else []
    if not 0 <= group < len(groups):
        raise FooterError(f"{path} has no row group {group}")
    return cut_group(path, footer, groups[group], group, data_end)


def cut_group(path: str, head: Typed, source: Typed, group: int, data_end: int | None = None) -> bytes:
    """``split_group`` from the row group's own footer entry and the footer without row groups."""
    members = chunks_of(path, source)
    low, high = min(c.source.start for c in members), max(c.source.start + c.source.length for c in members)
    if data_end is not None and high > data_end:
        raise ChunkError(f"{path}: row group {group} ends at byte {high}, the data at {data_end}")
    columns = [c.moved(len(MAGIC) + c.source.start - low, (low, high)) for c in members]
    entry = source | {G_COLUMNS: (LIST, (STRUCT, columns)), G_OFFSET: (I64, len(MAGIC)), G_ORDINAL: (I16, 0)}
    return MAGIC + Range(path, low, high - low).read() + footer_bytes(head, [entry])
