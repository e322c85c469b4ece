"""Streams give what batches give."""

from cytoframe.operators import levels as L
from cytoframe.sources import text as T
from cytoframe.streaming import incremental as I


def test_counts_of_arriving_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.counts").write_text("".join(f"chr{p % 2}\t{p}\t+\tCpG\t0.5\t{2 * k + 2}\n" for p in range(k, k + 4)))
    sites = I.site_stream(spark, str(folder))
    for name, stream in (("merged", I.merged_counts(sites)), ("levels", I.running_levels(sites))):
        q = stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    batch = T.parse_counts(T.lines(spark, str(folder)))
    assert sorted(map(tuple, spark.table("merged").collect())) == sorted(map(tuple, I.merged_counts(batch).collect()))
    assert sorted(map(tuple, spark.table("levels").collect())) == sorted(map(tuple, batch.groupBy("chrom").agg(*L.counters()).collect()))
