"""C02 with quoted line breaks: records cut by many tasks equal Spark's one-task read."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saleslens.sources import export, load_sales_csv, sales_schema
from saleslens.sources.csv_records import INSIDE, OUTSIDE, STAYS, TURNS, csv_records, line_effect, lines_of
from saleslens.sources.csv_source import CORRUPT, csv_reader_options, read_text_cells, text_schema

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("a", "b", "c")])


@pytest.fixture
def small_splits(spark):
    """Files of a few thousand bytes are cut into a dozen splits."""
    names = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "12"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


def one_task(spark, path):
    return (
        spark.read.options(**csv_reader_options(True))
        .schema(text_schema(SCHEMA))
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
    )


def listed(df):
    return sorted(str(tuple(r)) for r in df.select("a", "b", "c", F.col(CORRUPT).isNotNull()).collect())


def cell(draw):
    kind = draw.random()
    text = "".join(draw.choice(["x", "yz", "é", " ", "7"]) for _ in range(draw.randint(0, 12)))
    if kind < 0.4:
        return text
    special = "".join(draw.choice(["\n", '""', ",", text, "\r\n", "\n\n", ',""']) for _ in range(draw.randint(0, 5)))
    return f'"{special}"'


@pytest.mark.parametrize("seed,end", [(1, "\n"), (2, "\r\n")])
def test_equals_the_one_task_read(spark, tmp_path, small_splits, seed, end):
    draw = random.Random(seed)
    for k in range(2):
        rows = ["a,b,c"] + [",".join(cell(draw) for _ in range(draw.choice([3, 3, 3, 2, 4]))) for _ in range(150)]
        if k == 1:  # a cell that many splits have no start of a record in
            rows.insert(70, 'x,"' + "\n".join('long "" cell, of many lines' for _ in range(60)) + '",z')
        with open(tmp_path / f"{k}.csv", "w", newline="") as f:
            f.write(end.join(rows) + (end if k else ""))
    path = str(tmp_path)
    lines = lines_of(spark.read.option("lineSep", "\n").text(path))
    assert lines.rdd.getNumPartitions() > 8
    assert listed(read_text_cells(spark, path, SCHEMA)) == listed(one_task(spark, path))


def test_quotes_inside_plain_cells_are_text(spark, tmp_path, small_splits):
    rows = ["a,b,c"] + ['5" pipe,x,y', 'plain,"two\nlines",z', 'it"s,"q",k'] * 30
    path = tmp_path / "q.csv"
    path.write_text("\n".join(rows) + "\n")
    got = [tuple(r)[:3] for r in read_text_cells(spark, str(path), SCHEMA).collect()]
    assert sorted(got) == sorted([('5" pipe', "x", "y"), ("plain", "two\nlines", "z"), ('it"s', "q", "k")] * 30)
    assert listed(read_text_cells(spark, str(path), SCHEMA)) == listed(one_task(spark, str(path)))


@pytest.mark.parametrize("body", ["", "a,b,c", "a,b,c\n", "\n\na,b,c\n\n1,2,3\n\n", 'a,"b\nb",c\n1,"2\n\n2",3', 'a,b,c\n1,"open\nto the end'])
def test_small_files(spark, tmp_path, body):
    path = tmp_path / "s.csv"
    path.write_text(body)
    assert listed(read_text_cells(spark, str(path), SCHEMA)) == listed(one_task(spark, str(path)))


def test_a_header_that_crosses_a_split(spark, tmp_path, small_splits):
    path = tmp_path / "h.csv"
    path.write_text('a,"' + "name\n" * 100 + '",c\n1,2,3\n')
    assert [r.record for r in csv_records(lines_of(spark.read.option("lineSep", "\n").text(str(path)))).collect()] == ["1,2,3"]


def test_line_effects(spark):
    cases = {
        "a,b": STAYS, 'a,"b': TURNS, 'b",c': OUTSIDE, '"a",b': OUTSIDE, 'x"y': OUTSIDE, '"': TURNS, '""': STAYS, '"""': TURNS,
        'a",b,"c': INSIDE, '"a","b': TURNS, "": STAYS, '5" pipe,"x': TURNS, '","': OUTSIDE, '"a""': TURNS,
    }
    df = spark.createDataFrame([(k,) for k in cases], "line string")
    got = {r.line: r.e for r in df.select("line", line_effect(F.col("line")).alias("e")).collect()}

    def ends_inside(line, inside):
        at_start, i = True, 0
        while i < len(line):
            if inside:
                if line.startswith('""', i):
                    i += 2
                    continue
                if line[i] == '"':
                    inside, at_start = False, False
            elif line[i] == ",":
                at_start = True
            elif line[i] == '"' and at_start:
                inside = True
            else:
                at_start = False
            i += 1
        return inside

    effects = {(False, True): STAYS, (True, False): TURNS, (False, False): OUTSIDE, (True, True): INSIDE}
    for line in cases:
        assert got[line] == effects[ends_inside(line, False), ends_inside(line, True)], line


def test_fact_with_line_breaks_round_trips(spark, fact, tmp_path, small_splits):
    broken = fact.limit(40).withColumn("product_name", F.concat("product_name", F.lit('\n"x",\r\ny')))
    path = str(tmp_path / "c")
    export(broken, path, fmt="csv")
    good, rejects = load_sales_csv(spark, path, schema=sales_schema(row_id_type=T.LongType()))
    assert rejects.count() == 0
    assert sorted(str(tuple(r)) for r in good.collect()) == sorted(str(tuple(r)) for r in broken.collect())


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_record_is_parsed_once_whatever_is_filtered(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("quantity", T.ShortType()), T.StructField("market", T.StringType())])
    path = tmp_path / "p.csv"
    path.write_text(f"a,quantity,market\n1,2,x\nn,2,x\n1,256,x\n1,2,{'M' * 31}\n1,2\n")
    good, rejects = load_sales_csv(spark, str(path), schema=schema)
    for part in (good, rejects):
        # one for the records inside splits and one for those that cross a border
        assert plan_of(part).count("from_csv(") <= 2
    assert [tuple(r) for r in good.collect()] == [(1, 2, "x")]
    reasons = ["market longer than 30", "quantity out of range", "unparsable cell", "unparsable cell"]
    assert sorted(r.reject_reason for r in rejects.collect()) == reasons


def test_records_are_cut_without_a_walk_over_cells(spark, tmp_path):
    path = tmp_path / "w.csv"
    long = '""' * 100_000 + "," * 100_000
    path.write_text(f'a,b,c\n1,"x\n{long}\n",3\n1,2\n')
    cells = read_text_cells(spark, str(path), SCHEMA)
    # a higher-order function over the cells would run row by row in the interpreter
    assert "split(" not in plan_of(cells) and "aggregate(" not in plan_of(cells)
    assert listed(cells) == listed(one_task(spark, str(path)))
