import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from evalspark.sources import csvs, records


def content(seed, rows, end, width=4):
    rng = random.Random(seed)
    parts = ["a", "é", ",", '"', "\n", "\r\n", " ", "meta", "日", '""', "x" * 30]
    out = io.StringIO()
    write = csv.writer(out, lineterminator=end)
    write.writerow(["h1", 'two\n"lines"', *["h"] * (width - 2)])
    for k in range(rows):
        if rng.random() < 0.1:
            out.write(end)
        write.writerow([rng.choice(["meta", "other", " "]), *["".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(width - 1)]])
    return out.getvalue()


def truth(text):
    return [r for r in csv.reader(io.StringIO(text, newline="")) if r][1:]


def put(path, text):
    path.write_bytes(text.encode())
    return str(path)


def got(spark, path):
    rows = csvs.read_csv_rows(spark, path, multiline=True).orderBy("row_index").collect()
    assert [r.row_index for r in rows] == list(range(len(rows)))
    return [r.cells for r in rows]


@pytest.fixture
def block(spark):
    """Sets the size of the blocks a file is split into."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
    before = {k: spark.conf.get(k, None) for k in names}

    def use(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], 0)
        spark.conf.set(names[2], 1)

    yield use
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_cut_at_every_byte(spark, end):
    """All cuts in one job: the file of cut p has its lines that begin before p in one block."""
    text = content(1, 12, end)
    size = len(text.encode())
    rows = []
    for cut in range(size + 1):
        at = 0
        for k, line in enumerate(text.encode().split(b"\n")):
            if line or at < size:
                rows.append(("f%04d" % cut, 0 if at < cut else cut, k, line.decode()))
            at += len(line) + 1
    lines = spark.createDataFrame(rows, "_file string, _block long, _line long, value string").repartition(4)
    pieces = records.block_pieces(lines, records.block_states(lines))
    found = pieces.where("not edge").select("_file", "_block", "_record", "text").union(records.stitched(pieces.where("edge")))
    by = {}
    for r in found.select("_file", "_block", "_record", records.strict(F.col("text")).alias("text")).collect():
        by.setdefault(r._file, []).append((r._block, r._record, r.text))
    want = list(csv.reader(io.StringIO(text, newline="")))
    assert len(by) == size + 1
    for pieces in by.values():
        assert [next(csv.reader([t])) if "\n" not in t else next(csv.reader(io.StringIO(t, newline=""))) for *_, t in sorted(pieces) if t] == [r for r in want if r]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equal_to_one_reader(spark, tmp_path, block, end):
    text = content(2, 12, end)
    path, want = put(tmp_path / "a.csv", text), truth(text)
    for k in (13, 64, len(text.encode())):
        block(k)
        assert got(spark, path) == want, k
    if end == "\n":  # Spark's own reader takes the line end of the header's quoted field for that of the file
        assert [[c or "" for c in r] for r in csvs._scan(spark, True).csv(path).collect()] == want


def test_many_files_and_long_records(spark, tmp_path, block):
    texts = [content(k, 30, "\n") for k in range(3)] + ["h,i,j,k\n", 'h,i,j,k\nmeta,"' + "line\n" * 200 + '",q,a\nmeta,d,q,a']
    for k, t in enumerate(texts):
        put(tmp_path / f"f{k}.csv", t)
    block(64)
    want = [r for t in texts for r in truth(t)]
    assert got(spark, str(tmp_path)) == want
    samples = csvs.read_samples_csv(spark, str(tmp_path), multiline=True).orderBy("original_index").collect()
    usable = [r for r in want if r[0].strip()]
    assert [(s.original_index, s.meta.meta_description) for s in samples] == [(k, r[1]) for k, r in enumerate(usable)]


def test_one_file_is_read_by_many_tasks(spark, tmp_path, block):
    text = "a,b,c\n" + "".join(f'meta,"d\n{k}",x\n' for k in range(4000))
    path = put(tmp_path / "a.csv", text)
    block(4096)
    lines = records.text_lines(spark, path)
    blocks = lines.groupBy("_block").count().collect()
    assert len(blocks) == -(-len(text) // 4096) and max(r["count"] for r in blocks) < 1000
    assert len(got(spark, path)) == 4000


def test_records_are_cut_where_their_lines_are_read(spark, tmp_path, block, capfd):
    """No shuffle or sort of the records: a task never holds a block's lines, however many."""
    text = "a,b,c\n" + "".join(f'meta,"d\n{k}",x\n' for k in range(500))
    path = put(tmp_path / "a.csv", text)
    block(2048)
    lines = records.text_lines(spark, path)
    states = records.block_states(lines)
    capfd.readouterr()
    records.cut_in_order(records.with_states(lines, states)).explain()
    plan = capfd.readouterr().out
    assert "MapInArrow" in plan and not any(x in plan for x in ("Exchange hash", "Sort", "Window"))
    assert got(spark, path) == truth(text)


@pytest.mark.parametrize("bad", ['a,b\nmeta,"x\n', 'a,b\nmeta,x"y"\n', 'a,b\nmeta,"x"y\n', "a,b\nmeta\n", "a,b\nmeta,x,y\n", 'a,b\nme"ta,x\nmeta,y"z\n'])
def test_what_no_strict_reader_takes_fails(spark, tmp_path, bad):
    with pytest.raises(Exception):
        csvs.read_csv_rows(spark, put(tmp_path / "a.csv", bad), multiline=True).collect()


def test_good_quotes_pass(spark, tmp_path):
    text = 'a,b,c\n"","""","a"""\n"""a""",",",""",""\n"""\n"",,""\n'
    assert got(spark, put(tmp_path / "a.csv", text)) == truth(text)


def test_empty_files(spark, tmp_path):
    put(tmp_path / "a.csv", "a,b\n")
    assert got(spark, str(tmp_path)) == []
    assert csvs.preview_csv_file(spark, str(tmp_path)).collect() == []


def test_preview_reads_the_first_lines_only(spark, tmp_path, block):
    texts = [content(5, 9, "\n"), content(6, 400, "\n")]
    for k, t in enumerate(texts):
        put(tmp_path / f"f{k}.csv", t)
    rows = csvs.read_csv_rows(spark, str(tmp_path), multiline=True)
    for n, lines in ((5, 4), (12, 3), (5, 4000)):
        want = csvs.preview_csv(rows, n).orderBy("row").collect()
        assert csvs.preview_csv_file(spark, str(tmp_path), n, lines).orderBy("row").collect() == want and len(want) == n
    # A broken end, far behind the preview, is not read.
    put(tmp_path / "f2.csv", content(7, 50, "\n") + 'meta,"open')
    block(256)
    assert csvs.preview_csv_file(spark, str(tmp_path / "f2.csv"), 2, 16).count() == 2
    with pytest.raises(Exception):
        csvs.preview_csv_file(spark, str(tmp_path / "f2.csv"), 500, 16).count()
