"""The test tables emptied, and with rows of nulls, repeats and clashing extra columns put in."""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

TABLES = ["symbols", "edges", "enrichment", "change_sets", "repo_meta", "documents", "eval_items", "mix_targets", "embeddings"]
#: Names that operators use inside.
CLASH = ["key", "lane", "node", "parent", "path", "_salt", "tail", "description", "bits", "copied", "n0", "m", "deps", "score", "at", "h", "rank", "module", "section", "_n"]


def write(source: str, target: Path, how: str) -> str:
    target.mkdir(parents=True, exist_ok=True)
    for name in TABLES:
        t = pq.read_table(f"{source}/{name}.parquet")
        if how == "empty":
            t = t.slice(0, 0)
        elif how == "nulls":
            none = pa.table({f.name: pa.nulls(3, f.type) for f in t.schema}, schema=pa.schema([pa.field(f.name, f.type) for f in t.schema]))
            t = pa.concat_tables([t.cast(none.schema), none, t.slice(0, 5).cast(none.schema)])
            for c in CLASH:
                if c not in t.column_names:
                    t = t.append_column(c, pa.array(["x"] * len(t)))
        elif how == "only nulls":
            t = pa.table({f.name: pa.nulls(4, f.type) for f in t.schema}, schema=pa.schema([pa.field(f.name, f.type) for f in t.schema]))
        pq.write_table(t, target / f"{name}.parquet")
    return str(target)
