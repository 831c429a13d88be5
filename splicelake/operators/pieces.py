"""Variants written into long sequences, and positions moved along, in time linear in both.

The variants of a row are sorted cut points with the net length of all before each: positions move by a binary search in them, and the
sequence is cut once at all of them and joined once. A row's own columns bound what a task holds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from splicelake.operators.windows import VARIANTS, parse_variants


class Cuts:
    """Variants of one row that lie inside [start, end] and don't begin inside an earlier kept deletion, in order of position."""

    def __init__(self, variants: Sequence[dict], start: int | None, end: int | None):
        self.kept, self.n_all, reach = [], len(variants), -1
        for v in variants:
            last = v["pos"] + len(v["ref"]) - 1
            if start is None or end is None or v["pos"] < start or last > end or v["pos"] <= reach:
                continue
            self.kept.append(v)
            reach = max(reach, last) if len(v["ref"]) > 1 else reach
        self.pos = np.array([v["pos"] for v in self.kept], np.int64)
        self.net = np.concatenate([[0], np.cumsum([len(v["alt"]) - len(v["ref"]) for v in self.kept])]).astype(np.int64)

    def moved(self, positions: np.ndarray) -> np.ndarray:
        """Positions after the net length of the variants at or before them."""
        return positions + self.net[np.searchsorted(self.pos, positions, "right")]

    def usable(self, seq: str, start: int) -> list[dict]:
        """Kept variants that are alone at their position and whose reference stands in the sequence."""
        alone = np.ones(len(self.pos), bool)
        same = self.pos[1:] == self.pos[:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
        return [v for v, single in zip(self.kept, alone) if single and seq[v["pos"] - start : v["pos"] - start + len(v["ref"])] == v["ref"]]

    def written(self, seq: str, start: int) -> tuple[str, int]:
        """The sequence with the usable variants, and their number; a deletion keeps the first reference base."""
        parts, at, used = [], 0, self.usable(seq, start)
        for v in used:
            cut = v["pos"] - start
            parts += [seq[at:cut], v["ref"][:1] if len(v["ref"]) > len(v["alt"]) else v["alt"]]
            at = cut + len(v["ref"])
        return "".join([*parts, seq[at:]]), len(used)


def edited_rows(rows: DataFrame, positions: Sequence[str] = ("exon_ends", "exon_starts"), keep: Sequence[str] = ("uid",), seq: str | None = "seq") -> DataFrame:
    """``keep`` columns; original_end, gend and the ``positions`` arrays after the variants; n_dropped; n_variants, n_applied and the written ``seq``.

    Rows have gstart, gend and variant_list. A row without bounds keeps no variant, a null array or sequence stays null.
    """
    names = [*keep, "gstart", "gend", *positions, *([seq] if seq else [])]
    source = rows.select(*names, parse_variants(rows["variant_list"]).cast(VARIANTS).alias("_v"))
    kinds = {f.name: f.dataType for f in source.schema.fields}
    out = {c: kinds[c].simpleString() for c in [*keep, "gend", *positions]} | {"original_end": kinds["gend"].simpleString(), "n_dropped": "int", "n_variants": "int", "n_applied": "int"} | ({seq: "string"} if seq else {})

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {c: to_arrow_type(kinds[c]) for c in [*keep, "gend", *positions]}
        for batch in batches:
            found: dict[str, list] = {c: [] for c in out if c not in keep}
            column = lambda c: batch.column(c).to_pylist()
            texts = column(seq) if seq else [None] * batch.num_rows
            for start, end, variants, text, *lists in zip(column("gstart"), column("gend"), column("_v"), texts, *[column(c) for c in positions]):
                cuts = Cuts(variants or [], start, end)
                found["gend"].append(None if end is None else end + int(cuts.net[-1]))
                found["original_end"].append(end)
                found["n_dropped"].append(cuts.n_all - len(cuts.kept))
                found["n_variants"].append(len(cuts.kept))
                for c, p in zip(positions, lists):
                    found[c].append(None if p is None else cuts.moved(np.array(p, np.int64)).tolist())
                new, used = (None, 0) if text is None or start is None else cuts.written(text, start)
                found["n_applied"].append(used)
                if seq:
                    found[seq].append(text if start is None else new)
            arrow = {c: types.get(c, pa.string() if c == seq else types["gend"] if c == "original_end" else pa.int32()) for c in out}
            yield pa.record_batch([batch.column(c) if c in keep else pa.array(found[c], arrow[c]) for c in out], list(out))

    return source.mapInArrow(edit, ", ".join(f"`{c}` {t}" for c, t in out.items()))
