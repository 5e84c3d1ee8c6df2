import socket
import threading
import time

import pytest
from aerolytics import operators as op
from aerolytics import queries, sinks
from aerolytics.plans import flights
from aerolytics.sources import directory_lines, kafka_lines, socket_lines
from aerolytics.streaming import TWINS, batch_word_counts, run_twin
from pyspark.sql.datasource import DataSource, DataSourceWriter, SimpleDataSourceStreamReader, WriterCommitMessage

SF = "/root/testdata/sf0.001"


def test_reports(spark, tmp_path):
    f = flights(spark, SF)
    counts = op.top(op.endpoint_counts(f), "n", "airport")
    path = str(tmp_path / "report")
    assert sinks.report_flat(counts, "airport", "n", path)
    first = counts.first()
    lines = open(path).read().splitlines()
    assert len(lines) == 10 and lines[0] == f"{first.airport}  {first.n}"
    per = op.smallest_per(op.mean_delay(f, ["origin", "carrier"], "dep_delay"), "origin", "avg_delay", "carrier")
    key = per.first().origin
    assert sinks.report_sections(per, "origin", "carrier", "avg_delay", path, [key, "ZZZ"])
    lines = open(path).read().splitlines()
    assert lines[0] == f"--- {key} ---" and len(lines) <= 11 and lines[1].startswith("(")
    # every row is written, whatever their number
    best = op.best_flights(f)
    assert sinks.report_best(best, path) and len(open(path).read().splitlines()) == best.count() > 1000
    row = best.orderBy("origin", "dest", "flight_date", "am_or_pm").first()
    assert open(path).readline() == f"{row.origin} -> {row.dest} on {row.flight_date}: Flight: {row.carrier} {row.flight_num} at {row.departure_time}. Arrival Delay: {row.arr_delay}\n"
    routes = op.mean_delay(f, ["origin", "dest"], "arr_delay")
    assert sinks.report_routes(routes, "avg_delay", path) and len(open(path).read().splitlines()) == routes.count()
    before = open(path).read()
    assert not sinks.report_flat(counts.limit(0), "airport", "n", path) and not sinks.report_routes(routes.limit(0), "avg_delay", path) and open(path).read() == before
    assert sinks.console_sample(counts, 3) == 10


def test_key_value_text(spark, tmp_path):
    m = spark.createDataFrame([("JFK", "LAX", 1.5), ("SEA", "SEA", None)], "a string, b string, v double")
    sinks.write_key_value(m, ["a", "b"], "v", str(tmp_path / "kv"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "kv")).collect()) == ["JFK LAX\t1.5", "SEA SEA\t"]
    counts = spark.createDataFrame([("San Juan", 12)], "airport string, n long")
    sinks.write_key_value(counts, ["airport"], "n", str(tmp_path / "kv"))
    assert [tuple(r) for r in op.first_token_counts(spark.read.text(str(tmp_path / "kv"))).collect()] == [("San", 12)]


def make(spark, *rows):
    return spark.createDataFrame(list(rows), "k string, v long")


def test_keyed_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda: sorted(tuple(r) for r in sinks.read_table(spark, path).collect())
    assert sinks.read_table(spark, path) is None and not sinks.upsert_rows(make(spark), path, ["k"])
    sinks.upsert_rows(make(spark, ("a", 1), ("b", 2)), path, ["k"])
    for _ in range(2):  # the same rows again change nothing
        sinks.upsert_rows(make(spark, ("b", 3), ("c", 4)), path, ["k"])
        assert rows() == [("a", 1), ("b", 3), ("c", 4)]
    sinks.append_rows(make(spark, ("a", 9)), path)
    assert len(rows()) == 4
    sinks.overwrite_rows(make(spark, ("z", 0)), path)
    assert rows() == [("z", 0)] and not sinks.overwrite_rows(make(spark), path)
    assert len(sinks.versions(spark, path)) == 2  # older ones are gone


def test_appends_write_their_own_rows_only_and_batches_once(spark, tmp_path):
    path = str(tmp_path / "t")
    for batch in (0, 1, 1, 2, 2):  # batches 1 and 2 are delivered again
        sinks.append_rows(make(spark, ("k", batch)), path, batch)
    assert sorted(r.v for r in sinks.read_table(spark, path).collect()) == [0, 1, 2]
    assert sinks.versions(spark, path) == [1] and len(list((tmp_path / "t/v=1").glob("part=batch-*"))) == 3
    other = str(tmp_path / "o")
    for batch in (0, 1, 1):
        sinks.overwrite_rows(make(spark, ("k", batch)), other, batch)
    assert sinks.versions(spark, other) == [1, 2] and sinks.read_table(spark, other).first().v == 1
    third = str(tmp_path / "u")
    for batch in (0, 1, 1, 2):
        sinks.upsert_rows(make(spark, (f"k{batch % 2}", batch)), third, ["k"], batch)
    assert sorted(tuple(r) for r in sinks.read_table(spark, third).collect()) == [("k0", 2), ("k1", 1)]


@pytest.fixture
def several(spark, tmp_path):
    """The smallest tables, with lineitem as a folder of three files."""
    for t in ("supplier", "orders", "customer", "part", "nation"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    spark.read.parquet(f"{SF}/lineitem.parquet").repartition(3).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def ordered(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


#: The batch question of each twin.
BATCH = {"q11": "q11_top10_airports", "q12": "q12_top10_carriers", "q21": "q21_top10", "q22": "q22_top10", "q24": "q24_mean_arrival", "q32": "q32_best_flights"}


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin_equals_batch_over_several_batches(spark, several, name):
    seen = []
    got = run_twin(spark, several, name, sinks=(lambda d: seen.append(d.count()),), files_per_batch=1)
    assert len(seen) == 3  # the rate limit holds: a file a micro-batch
    assert ordered(got) == ordered(queries.QUERIES[BATCH[name]](spark, SF))


def test_twin_goes_on_from_its_checkpoint(spark, several, tmp_path):
    base, seen = str(tmp_path / "base"), []
    files = sorted((tmp_path / "lineitem.parquet").glob("*.parquet"))
    late = files[0].rename(tmp_path / "late")
    first = run_twin(spark, several, "q24", sinks=(lambda d: seen.append(1),), base=base)
    assert len(seen) == 1 and ordered(first) != ordered(queries.QUERIES["q24_mean_arrival"](spark, SF))
    late.rename(files[0].with_name("part-9.parquet"))
    again = run_twin(spark, several, "q24", sinks=(lambda d: seen.append(1),), base=base)
    assert len(seen) == 2  # one batch more: the new file alone is read, over the state kept
    assert ordered(again) == ordered(queries.QUERIES["q24_mean_arrival"](spark, SF))
    assert ordered(run_twin(spark, several, "q24", sinks=(lambda d: seen.append(1),), base=base)) == ordered(again) and len(seen) == 2


def test_state_runs_on_over_batches_and_word_counts_do_not(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.txt").write_text("a b\na\n")
    (folder / "2.txt").write_text("a\n")
    batches = []
    q = batch_word_counts(directory_lines(spark, str(folder), 1), lambda d: batches.append({r.word: r.n for r in d.collect()}), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted(b["a"] for b in batches) == [1, 2]
    totals = []
    counts = directory_lines(spark, str(folder), 1).selectExpr("explode(split(value, ' ')) AS word").groupBy("word").count()
    q = counts.writeStream.outputMode("complete").foreachBatch(lambda d, _: totals.append({r.word: r["count"] for r in d.collect()})).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert totals[-1] == {"a": 3, "b": 1}


def test_console_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.txt").write_text("one\ntwo\nthree\n")
    q = sinks.console_stream(directory_lines(spark, str(folder)), str(tmp_path / "cp"), 2, once=True)
    q.awaitTermination()
    done = q.recentProgress  # the JVM prints where it was started, so what it says of the sink is held here
    assert sum(p.numInputRows for p in done) == 3 and "ConsoleTable" in done[0].sink.description


def test_socket_lines(spark):
    server = socket.create_server(("localhost", 0))

    def serve():
        peer, _ = server.accept()
        peer.sendall(b"a b\nc\n")
        time.sleep(20)
        peer.close()

    threading.Thread(target=serve, daemon=True).start()
    lines = socket_lines(spark, "localhost", server.getsockname()[1])
    q = lines.writeStream.format("memory").queryName("socket_rows").start()
    try:
        for _ in range(100):
            q.processAllAvailable()
            if spark.table("socket_rows").count() == 2:
                break
            time.sleep(0.1)
        assert sorted(r.value for r in spark.table("socket_rows").collect()) == ["a b", "c"]
    finally:
        q.stop()
        server.close()


class StandIn(DataSource):
    """A message queue that takes the connector's options: a folder of files, one message a line."""

    @classmethod
    def name(cls):
        return "standin"

    def schema(self):
        return "key binary, value binary"

    def simpleStreamReader(self, schema):
        return Messages(self.options)

    def writer(self, schema, overwrite):
        return Sender(self.options)


class Messages(SimpleDataSourceStreamReader):
    def __init__(self, options):
        assert options["startingOffsets"] == "earliest" and options["kafka.bootstrap.servers"] == "here:1"
        self.path, self.most = options["subscribe"], int(options.get("maxOffsetsPerTrigger", 10**9))

    def lines(self):
        return open(self.path, "rb").read().splitlines()

    def initialOffset(self):
        return {"at": 0}

    def read(self, start):
        got = self.lines()[start["at"] : start["at"] + self.most]
        return iter([(b"k", x) for x in got]), {"at": start["at"] + len(got)}

    def readBetweenOffsets(self, start, end):
        return iter([(b"k", x) for x in self.lines()[start["at"] : end["at"]]])


class Sender(DataSourceWriter):
    def __init__(self, options):
        self.path = options["topic"]

    def write(self, rows):
        with open(self.path, "a") as out:
            out.writelines(f"{r.value}\n" for r in rows)
        return WriterCommitMessage()


def test_message_queue_by_a_stand_in(spark, tmp_path):
    import sys

    from pyspark import cloudpickle as spark_pickle

    spark_pickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(StandIn)
    (tmp_path / "input").write_text("a b\nc\nd\n")
    got, sizes = [], []

    def take(batch, _):
        rows = [r.value for r in batch.collect()]
        got.extend(rows)
        sizes.append(len(rows))

    lines = kafka_lines(spark, "here:1", str(tmp_path / "input"), offsets_per_batch=2, connector="standin")
    assert lines.columns == ["value"]
    q = lines.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert got == ["a b", "c", "d"] and max(sizes) == 2
    f = op.mean_delay_cents(flights(spark, SF), ["origin", "dest"], "arr_delay")
    sinks.to_kafka(sinks.route_messages(f, ("origin", "dest", "avg_cents")), "here:1", str(tmp_path / "out"), connector="standin")
    assert len((tmp_path / "out").read_text().splitlines()) == f.count()
