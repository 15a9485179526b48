"""Many strings looked for at once: the sections of a document's map in its lines or chunks."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import ship

ENTRY = ("first_page", "first_line", "number", "title", "level", "type", "parent")
TITLE_PREFIX = 20
# Pages of one document in a block: blocks of a document lie in different tasks.
BLOCK_PAGES = 1024
# Sections in one automaton, about 1 KB each.
SLICE = 50_000
# Bytes of text kept while the automata of a map of several slices pass over them.
HELD_BYTES = 16 << 20


class Automata:
    """Two Aho-Corasick automata over a slice of a map: section numbers, and the starts of titles."""

    def __init__(self, numbers: list, titles: list, first: int):
        self.numbers, self.titles, self.title_of = defaultdict(list), defaultdict(list), {}
        for at, (number, title) in enumerate(zip(numbers, titles), first):
            if number is not None:
                self.numbers[number].append(at)
            if title is not None:
                self.titles[title].append(at)
                self.title_of[at] = title
        self._number = self._build(self.numbers)
        self._title = self._build(self.titles)

    @staticmethod
    def _build(words):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word in words:
            if word:
                automaton.add_word(word, word)
        if len(automaton):
            automaton.make_automaton()
        return automaton

    @staticmethod
    def _hits(automaton, words, text: str | None) -> set:
        if text is None:
            return set()
        found = {word for _, word in automaton.iter(text)} if len(automaton) else set()
        return found | {""} if "" in words else found

    def first_with_both(self, text: str | None, folded: str | None) -> list[int]:
        """The first section whose number stands in `text` and whose title's start stands in `folded`."""
        held = self._hits(self._number, self.numbers, text)
        if not held:
            return []
        started = self._hits(self._title, self.titles, folded)
        both = [at for number in held for at in self.numbers[number] if self.title_of.get(at) in started]
        return [min(both)] if both else []

    def every_with_either(self, text: str | None, folded: str | None) -> list[int]:
        """All sections whose number stands in `text`, or whose title's start stands in `folded`."""
        found = {at for number in self._hits(self._number, self.numbers, text) for at in self.numbers[number]}
        for title in self._hits(self._title, self.titles, folded):
            found.update(self.titles[title])
        return sorted(found)


class _Map:
    """The sections of one document, in map order, and the automata over their slices."""

    def __init__(self, slice_size: int, both: bool):
        self.parts, self.size, self.slice_size, self.both = [], 0, slice_size, both
        self._only = None

    def add(self, entries: pa.Table) -> None:
        self.parts.append(entries)
        self.size += entries.num_rows
        self._only = None

    def _slices(self, entries: pa.Table):
        if self._only is not None:
            yield self._only
            return
        for first in range(0, entries.num_rows, self.slice_size):
            part = entries.slice(first, self.slice_size)
            made = Automata(part.column("__number").to_pylist(), part.column("__title").to_pylist(), first)
            if entries.num_rows <= self.slice_size:
                self._only = made
            yield made

    def match(self, texts: list, folded: list | None, kind: pa.DataType) -> pa.Array:
        """array<struct<place, section>> a row; with `both` one section a place, else all."""
        if not self.size:
            return pa.array([[]] * len(texts), kind)
        if len(self.parts) > 1:
            self.parts = [pa.concat_tables(self.parts)]
        entries = self.parts[0]
        found: list[dict[int, list[int]]] = [{} for _ in texts]
        for automata in self._slices(entries):
            look = automata.first_with_both if self.both else automata.every_with_either
            for row, here in enumerate(texts):
                there = here if folded is None else folded[row]
                for place, (text, low) in enumerate(zip(here or (), there or ())):
                    if self.both and place in found[row]:
                        continue  # an earlier slice is earlier in the map
                    if hits := look(text, low):
                        found[row].setdefault(place, []).extend(hits)
        offsets, places, taken = [0], [], []
        for hits in found:
            for place in sorted(hits):
                places += [place] * len(hits[place])
                taken += hits[place]
            offsets.append(len(places))
        section_type = kind.value_type.field("section").type
        chosen = entries.select([f"__m_{f.name}" for f in section_type]).take(pa.array(taken, pa.int64())).combine_chunks()
        columns = [pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in chosen.columns]
        section = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, section_type)], fields=list(section_type))
        hit = pa.StructArray.from_arrays([pa.array(places, pa.int32()), section], fields=list(kind.value_type))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), hit).cast(kind)


def with_sections_found(rows: DataFrame, sections: DataFrame, texts: Column, out: str, both: bool,
                        folded: Column | None = None, title_key: Column | None = None,
                        slice_size: int = SLICE, block_pages: int = BLOCK_PAGES) -> DataFrame:
    """Rows (document_id, page_number, ...) with `out`: array<struct<place int, section struct>>.

    `texts` is an array of strings a row, `folded` the texts that titles are looked for in (the same without it) and
    `title_key` what a title must begin with (its first 20 characters without it). With `both`, a place holds the first
    section, in map order, whose number and title it contains; without, every section whose number or title it contains.

    One plan for maps of any size. Rows are shuffled once, by document and block of pages, and a document's map goes
    to each of its blocks; within a task the map's rows come before the rows they are looked for in, so that an automaton
    is built once a block and rows stream past it. Beyond `slice_size` sections several automata pass over runs of rows
    one after another: a task holds one automaton, a map's rows (some 100 bytes a section) and one run.
    Rows whose document is null, or has no map, find nothing. A null number or title is found nowhere, an empty one everywhere.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    ship(rows.sparkSession)
    entry = T.StructType([T.StructField(n, sections.schema[n].dataType) for n in ENTRY])
    hits = T.ArrayType(T.StructType([T.StructField("place", T.IntegerType()), T.StructField("section", entry)]))
    key = F.floor(F.coalesce("page_number", F.lit(0)) / block_pages).cast("long")
    title_key = F.substring("title", 1, TITLE_PREFIX) if title_key is None else title_key
    kept = rows.columns
    blocks = rows.select("document_id", key.alias("__block")).distinct()
    map_columns = [F.col(n).alias(f"__m_{n}") for n in ENTRY]
    maps = (
        sections.select("document_id", *map_columns, F.col("number").alias("__number"), title_key.alias("__title"))
        .join(blocks, "document_id").withColumn("__row", F.lit(False))
    )
    own = rows.withColumns({"__block": key, "__row": F.lit(True), "__texts": texts})
    if folded is not None:
        own = own.withColumn("__folded", folded)
    both_kinds = own.unionByName(maps, allowMissingColumns=True)
    order = ["document_id", "__block", "__row", *[f"__m_{n}" for n in ENTRY]]
    laid = both_kinds.repartition("document_id", "__block").sortWithinPartitions(*order)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, hits)])
    with_folded = folded is not None

    def run(batches):
        kind = to_arrow_type(hits)
        here, mapped, held, held_bytes = object(), _Map(slice_size, both), [], 0
        of_map = [f"__m_{n}" for n in ENTRY] + ["__number", "__title"]

        def flush():
            nonlocal held_bytes
            if not held:
                return
            part = pa.Table.from_batches(held)
            low = part.column("__folded").to_pylist() if with_folded else None
            found = mapped.match(part.column("__texts").to_pylist(), low, kind)
            made = part.select(kept).append_column(out, found).combine_chunks()
            held.clear()
            held_bytes = 0
            yield from (pa.RecordBatch.from_arrays(b.columns, schema.names) for b in made.to_batches())

        for batch in batches:
            keys = list(zip(batch.column("document_id").to_pylist(), batch.column("__block").to_pylist()))
            is_row = batch.column("__row").to_pylist()
            begin = 0
            while begin < len(keys):
                end = begin
                while end < len(keys) and keys[end] == keys[begin] and is_row[end] == is_row[begin]:
                    end += 1
                part = batch.slice(begin, end - begin)
                if keys[begin] != here:
                    yield from flush()
                    here, mapped = keys[begin], _Map(slice_size, both)
                if is_row[begin]:
                    held.append(part)
                    held_bytes += part.column("__texts").get_total_buffer_size() * part.num_rows // max(1, batch.num_rows)
                    if mapped.size <= slice_size or held_bytes >= HELD_BYTES:
                        yield from flush()
                else:
                    mapped.add(pa.Table.from_batches([part.select(of_map)]))
                begin = end
        yield from flush()

    return laid.mapInArrow(run, schema)
