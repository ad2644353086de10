"""The channel file is written in more parts as there are more rows."""

import random

from meshflux.session import checkpoint_root
from workloads import ingest
from workloads.registry import QUERIES

COLUMNS = "l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string, l_linenumber int, l_quantity double, l_discount double, l_tax double"


def test_files_grow_with_the_rows(spark, tmp_path, monkeypatch):
    draw = random.Random(3)
    rows = [(draw.randrange(40), draw.randrange(9), draw.choice("ANR"), draw.choice("OF"), draw.randrange(1, 8), float(draw.randrange(1, 51)), draw.randrange(11) / 100, draw.randrange(9) / 100)
            for _ in range(900)] + [(None, 1, "N", "O", 1, 50.0, 0.1, 0.01)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/lineitem.parquet")
    paths, fresh = [], ingest.fresh_path
    monkeypatch.setattr(ingest, "fresh_path", lambda t, name: paths.append(fresh(t, name)) or paths[-1])

    def run():
        found = sorted((tuple(r) for r in QUERIES["link_file"](spark, str(tmp_path)).collect()), key=repr)
        return found, len([name for name in spark.read.format("binaryFile").load(paths[-1]).select("path").collect()])

    few = run()
    monkeypatch.setattr(ingest, "ROWS_PER_FILE", 60)
    many = run()
    assert few[0] == many[0] and len(few[0]) > 100
    assert few[1] <= 3 and 10 <= many[1] <= 16
    assert paths[0].startswith(checkpoint_root(spark))
