import bz2
import csv
import gzip
import io
import random
from collections import defaultdict
from urllib.parse import unquote

import pytest
from conftest import rows
from pyspark.sql import functions as F

from utterscope.operators import intent
from utterscope.plans import workflows
from utterscope.sources import corpus, files, quoted, reports

HEADER = (
    "Utterance,ExpectedIntent,MatchedIntent,ResultType,Entity Name,Entity Result,"
    "EntityIdentifiedBy,entityIdentifiedUsing,Notes\n"
)
RAW = (
    '"Bot Name:","Bank, retail"\n'
    '"Notes:","M1-RUN\n"\n'
    '"Threshold","Mode","min"\n'
    '"","ml","0.7"\n'
    '"","faq","65"\n'
    "no comma here\n"
    '"Breakdown:","80% TP","20% FP"\n'
    + HEADER
    + '"hello, there",Greet,greet,TP,,,,,first\n'
    + '"two\nlines ""quoted""",none,none,TN,Amount,TRUE,ML Engine,NER,\n'
    + "last,Greet,,FN,Amount,false,FM Engine,Full Match - x,third\n"
)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "M1-RUN_a.csv").write_text(RAW, encoding="utf-8")
    (tmp_path / "M1-RUN_b.csv").write_text(
        "MatchedIntent,Utterance,ResultType,ExpectedIntent\nbye,adiós,TP,Bye\n".replace(
            "MatchedIntent,Utterance", "Utterance,MatchedIntent"
        ).replace("bye,adiós", "adiós,bye"),
        encoding="utf-8",
    )
    (tmp_path / "broken.csv").write_text("a,b\nc,d\n", encoding="utf-8")
    (tmp_path / "only header_results.csv").write_text(HEADER, encoding="utf-8")
    return str(tmp_path)


def test_reports_are_split(spark, folder):
    split = reports.split_reports(spark, folder)
    found = {(r.report, r.utterance): r for r in reports.results(split).collect()}
    assert set(found) == {
        ("M1-RUN_a", "hello, there"),
        ("M1-RUN_a", 'two\nlines "quoted"'),
        ("M1-RUN_a", "last"),
        ("M1-RUN_b", "adiós"),
    }
    quoted = found["M1-RUN_a", 'two\nlines "quoted"']
    assert (quoted.expected, quoted.correct, quoted.engine) == ("none", True, "ML Engine")
    assert quoted.extra == {"Notes": None}
    last = found["M1-RUN_a", "last"]
    assert (last.matched, last.correct, last.method) == (None, False, "Full Match - x")
    assert last.extra == {"Notes": "third"}
    other = found["M1-RUN_b", "adiós"]
    assert (other.expected, other.matched, other.result_type, other.entity) == ("Bye", "bye", "TP", None)
    assert rows(reports.rejects(split)) == [("broken", reports.NO_HEADER)]
    manifest = reports.report_manifest(spark, folder)
    assert rows(manifest.select("report", "model")) == [
        ("M1-RUN_a", "M1-RUN"),
        ("M1-RUN_b", "M1-RUN"),
        ("broken", "broken"),
        ("only header", "only header"),
    ]


def test_reports_of_any_width_keep_all_cells(spark, tmp_path):
    names = ["Utterance", "ResultType", "Note", "Note", "", *(f"k{i}" for i in range(200))]
    values = ["hi", "TP", "n1", "n2", "n3", *(f"v{i}" for i in range(200)), "beyond", "", "last"]
    (tmp_path / "wide.csv").write_text(",".join(names) + "\n" + ",".join(values) + "\n", encoding="utf-8")
    (tmp_path / "narrow.csv").write_text('Utterance,ResultType\nho,FP\n"a\nb",FN\n', encoding="utf-8")
    split = reports.split_reports(spark, str(tmp_path))
    assert reports.rejects(split).count() == 0
    found = {r.utterance: r for r in reports.results(split).collect()}
    expected = {"Note": "n1", "Note.1": "n2", "_c4": "n3", "_c205": "beyond", "_c207": "last"}
    assert found["hi"].extra == expected | {f"k{i}": f"v{i}" for i in range(200)}
    assert (found["ho"].extra, found["a\nb"].extra, found["a\nb"].result_type) == ({}, {}, "FN")


def test_cells_beyond_every_line_are_kept(spark, tmp_path):
    (tmp_path / "odd.csv").write_text('Utterance,ResultType\n"a\nb",TP,"x\ny",z\n', encoding="utf-8")
    split = reports.split_reports(spark, str(tmp_path))
    assert reports.rejects(split).count() == 0
    row = reports.results(split).first()
    assert (row.utterance, row.result_type, row.extra) == ("a\nb", "TP", {"_c2": "x\ny", "_c3": "z"})


def test_stray_quotes_above_the_header_hide_nothing(spark, tmp_path):
    above = 'Bot,"Bank\n"Height,5" pipe\n""",x\n'
    table = 'Utterance,ResultType\nhi,TP\n5" pipe,"FN"\n"a ""b""\n,c",FP\n'
    (tmp_path / "stray.csv").write_text(above + table, encoding="utf-8")
    (tmp_path / "crlf.csv").write_bytes((above + table).replace("\n", "\r\n").encode())
    (tmp_path / "latin.csv").write_bytes("Utterance,ResultType\nñ,TP\n".encode("latin-1"))
    (tmp_path / "open.csv").write_text('Utterance,ResultType\nhi,TP\n"never closed,TP\nx,FP\n')
    split = reports.split_reports(spark, str(tmp_path))
    expected = [("hi", "TP"), ('5" pipe', "FN"), ('a "b"\n,c', "FP")]
    for name in ("stray", "crlf"):
        found = reports.results(split).where(f"report = '{name}'")
        assert rows(found.select("utterance", "result_type")) == sorted(expected)
    assert rows(reports.rejects(split)) == [("latin", quoted.NOT_TEXT), ("open", quoted.UNCLOSED)]
    assert rows(reports.results(split).select("report").distinct()) == [("crlf",), ("stray",)]


def plain_records(path, header_cell):
    """Records of one file by one reader over all of its lines."""
    lines = path.read_text(encoding="utf-8").splitlines()
    starts = [i for i, x in enumerate(lines) if header_cell is None or x.partition(",")[0].strip().strip('"') == header_cell]
    if not starts:
        return []
    return [[c or None for c in r] for r in csv.reader(f"{x}\n" for x in lines[starts[0] :]) if r]


@pytest.mark.parametrize("header_cell,limit", [("Utterance", 1 << 20), ("Utterance", 0), (None, 1 << 20), (None, 0)])
def test_records_of_files_cut_anywhere(spark, tmp_path, header_cell, limit):
    draw = random.Random(5)
    pieces = ["a", "é日", '"', '""', ",", "\n", ' "', '",', ',"', "Utterance", "Utterance,x\n", "\n\n", "long " * 20]
    for i in range(12):
        text = "".join(draw.choice(pieces) for _ in range(draw.randrange(1, 60)))
        (tmp_path / f"f{i}.csv").write_text(text + "\n", encoding="utf-8")
    (tmp_path / "wide cell.csv").write_text('Utterance,b\n"' + "line, of a ""quoted"" cell\n" * 150 + '",x\ny,"z\n"\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "61")
    try:
        found = quoted.read_records(spark, str(tmp_path), header_cell, limit=limit)
        faults = {files_name(r.path): r.fault for r in found.files.collect()}
        got = defaultdict(list)
        for r in found.records.collect():
            got[files_name(r.path)].append((not r.header, r.cells))
        assert spark.read.text(str(tmp_path / "wide cell.csv")).rdd.getNumPartitions() > 50
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    closed = 0
    for path in tmp_path.glob("*.csv"):
        lines = path.read_text(encoding="utf-8").splitlines()
        starts = [i for i, x in enumerate(lines) if header_cell is None or x.partition(",")[0].strip().strip('"') == header_cell]
        inside = False
        for line in lines[starts[0] :] if starts else []:
            inside = quoted.open_after(line, inside)
        fault = quoted.NO_HEADER if not starts else quoted.UNCLOSED if inside else None
        assert faults[path.name] == fault, path
        expected = [] if fault else plain_records(path, header_cell)
        closed += fault is None
        assert sorted(got[path.name], key=repr) == sorted([(i > 0, r) for i, r in enumerate(expected)], key=repr)
    assert closed >= 3


def files_name(path):
    return unquote(path.rpartition("/")[2])


def test_the_state_behind_a_line_is_that_of_a_csv_reader():
    draw = random.Random(6)
    for _ in range(3000):
        line = "".join(draw.choice('a",  "') for _ in range(draw.randrange(14)))
        for ahead in ("", '"'):
            got = list(csv.reader([ahead + "\n" * bool(ahead) + line + "\n", "end\n"]))
            assert quoted.open_after(line, bool(ahead)) == (got[-1] != ["end"]), line


def test_many_reports_in_one_task(spark, tmp_path):
    # More rows than one Arrow batch holds, and batches that span several files.
    for i in range(6):
        body = "".join(f"u{i}-{j},A,{'A' if j % 2 else 'none'},{'TP' if j % 2 else 'FN'}\n" for j in range(50 + 4000 * i))
        preamble = "".join(f"k{j},v\n" for j in range(i))
        (tmp_path / f"r{i}.csv").write_text(
            preamble + "Utterance,ExpectedIntent,MatchedIntent,ResultType\n" + body, encoding="utf-8"
        )
    split = reports.split_reports(spark, str(tmp_path)).coalesce(1)
    counted = reports.results(split).groupBy("report").agg(F.count("utterance").alias("n"))
    assert rows(counted) == [(f"r{i}", 50 + 4000 * i) for i in range(6)]
    assert rows(reports.preamble(spark, str(tmp_path)).groupBy("report").count()) == [
        (f"r{i}", i) for i in range(1, 6)
    ]


def test_preamble_and_metadata(spark, folder):
    lines = reports.preamble(spark, folder)
    verbatim = rows(lines.where("report = 'M1-RUN_a'"), "line_no")
    assert [r[2] for r in verbatim] == RAW.split("Utterance,")[0].splitlines()
    assert [r[1] for r in verbatim] == list(range(1, 9))
    values = {r[1]: r[2] for r in rows(reports.key_values(lines))}
    assert values == {
        "Bot Name:": "Bank, retail",
        "Notes:": "M1-RUN",
        "Threshold": 'Mode","min',
        "": 'faq","65',
        "Breakdown:": '80% TP","20% FP',
    }
    assert {r[0] for r in rows(lines)} == {"M1-RUN_a"}


def test_preamble_of_a_report_read_in_parts(spark, tmp_path):
    body = "".join(f"row {j},A,A,TP\n" for j in range(2000))
    (tmp_path / "big.csv").write_text("k,v\nk,w\nUtterance,ExpectedIntent\n" + body + "Utterance,again\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = reports.preamble(spark, str(tmp_path))
        assert rows(lines, "line_no") == [("big", 1, "k,v"), ("big", 2, "k,w")]
        assert rows(reports.key_values(lines)) == [("big", "k", "w")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_reports_named_by_their_folders(spark, tmp_path):
    for name in ("report=a b", "report=c%3D"):
        (tmp_path / name).mkdir()
        for i in range(2):
            text = f"k,{name[-1]}{i}\nk{i},v\nUtterance,ResultType\nu{i},TP\n"
            (tmp_path / name / f"part-{i}.csv").write_text(text)
    lines = reports.preamble(spark, str(tmp_path), report_folders=True)
    assert rows(lines.where("report = 'a b'"), "line_no") == [
        ("a b", 1, "k,b0"), ("a b", 2, "k0,v"), ("a b", 3, "k,b1"), ("a b", 4, "k1,v"),
    ]
    assert rows(reports.key_values(lines)) == [
        ("a b", "k", "b1"), ("a b", "k0", "v"), ("a b", "k1", "v"), ("c=", "k", "D1"), ("c=", "k0", "v"), ("c=", "k1", "v"),
    ]
    split = reports.results(reports.split_reports(spark, str(tmp_path), report_folders=True))
    assert rows(split.select("report", "utterance")) == [("a b", "u0"), ("a b", "u1"), ("c=", "u0"), ("c=", "u1")]
    known = reports.report_manifest(spark, str(tmp_path), report_folders=True)
    assert rows(known.select("report", "model").distinct()) == [("a b", "a b"), ("c=", "c=")]
    assert workflows.process_reports(spark, str(tmp_path), report_folders=True)["metadata"].count() == 6
    success = workflows.evaluate_reports(spark, str(tmp_path), report_folders=True)["entity_success"]
    assert [r.report for r in success.collect()] == ["a b", "c="]


def test_names(spark):
    paths = ["/a/b/P1-X_results.csv", "/a/with%20blank+plus_1.csv", "noext", "s3://x/y.z/m_1_2.csv"]
    frame = spark.createDataFrame([(p,) for p in paths], "p string")
    stem = files.file_stem(F.col("p"))
    got = [
        tuple(r)
        for r in frame.select(stem, reports.report_name(stem), files.model_name(stem)).collect()
    ]
    assert got == [
        ("P1-X_results", "P1-X", "P1-X"),
        ("with blank+plus_1", "with blank+plus_1", "with blank+plus"),
        ("noext", "noext", "noext"),
        ("m_1_2", "m_1_2", "m"),
    ]


@pytest.fixture
def corpora(tmp_path):
    texts = {
        "test": {"saldo": ["¿Cuánto, tengo?", "dos\nlíneas"], "vacío": [], "pago": ["pagar ya"]},
        "train": {"saldo": ["mi saldo", "", "otro saldo más"], "pago": ["quiero pagar"]},
    }
    for split, labels in texts.items():
        (tmp_path / split).mkdir()
        for label, lines in labels.items():
            out = io.StringIO()
            writer = csv.writer(out, quoting=csv.QUOTE_ALL)
            writer.writerow(["Display name, of " + label])
            writer.writerows([line] if line else [None] for line in lines)
            (tmp_path / split / f"{label}.csv").write_text(out.getvalue(), encoding="utf-8")
    (tmp_path / "train" / "ignored.txt").write_text("x\ny\n")
    return {split: str(tmp_path / split) for split in texts}


def test_corpus(spark, corpora):
    found = corpus.read_corpus(spark, corpora)
    assert rows(found) == [
        ("test", "pago", "pagar ya"),
        ("test", "saldo", "dos\nlíneas"),
        ("test", "saldo", "¿Cuánto, tengo?"),
        ("train", "pago", "quiero pagar"),
        ("train", "saldo", "mi saldo"),
        ("train", "saldo", "otro saldo más"),
    ]
    manifest = corpus.read_corpus_manifest(spark, corpora)
    assert rows(manifest) == [
        ("test", "pago"), ("test", "saldo"), ("test", "vacío"), ("train", "pago"), ("train", "saldo"),
    ]
    assert rows(corpus.missing_files(found, manifest)) == [("test", "vacío")]


def test_only_the_first_column_of_a_corpus_file_counts(spark, tmp_path):
    (tmp_path / "two.csv").write_text('Text,Note\n"a, b",x\nc,\n,only note\n', encoding="utf-8")
    found = corpus.read_folder(spark, str(tmp_path))
    assert rows(found) == [("two", "a, b"), ("two", "c")]


def test_damaged_corpus_files_give_one_reject_row(spark, tmp_path):
    (tmp_path / "good.csv").write_text('T\n"a\nb"\nc\n', encoding="utf-8")
    (tmp_path / "only header.csv").write_text("T\n", encoding="utf-8")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "latin.csv").write_bytes("T\nsí\nno\n".encode("latin-1"))
    (tmp_path / "open.csv").write_text('T\nfine\n"never closed\nx\n')
    scanned = corpus.scan_folder(spark, str(tmp_path))
    assert rows(corpus.texts(scanned)) == [("good", "a\nb"), ("good", "c")]
    expected = [("empty", quoted.NO_HEADER), ("latin", quoted.NOT_TEXT), ("open", quoted.UNCLOSED)]
    assert rows(corpus.rejects(scanned)) == expected
    tables = workflows.analyze_corpus(spark, str(tmp_path), str(tmp_path))
    assert rows(tables["rejects"].where("split = 'test'").drop("split")) == expected
    assert tables["intra_lexical"].where("split = 'train' and label = 'good'").first().vocab_size == 3


def test_damaged_packed_files_give_one_reject_row(spark, tmp_path):
    sound = gzip.compress(b'T\n"a\nb"\n' + b"".join(b"row %d\n" % i for i in range(2500)))
    (tmp_path / "good.csv.gz").write_bytes(sound)
    (tmp_path / "cut.csv.gz").write_bytes(sound[:-300])
    (tmp_path / "not.csv.gz").write_bytes(b"T\nplain\n")
    (tmp_path / "crc.csv.gz").write_bytes(sound[:-8] + b"\0" * 8)
    (tmp_path / "zero.csv.gz").write_bytes(b"")
    (tmp_path / "none.csv.gz").write_bytes(gzip.compress(b""))
    (tmp_path / "latin.csv.gz").write_bytes(gzip.compress("T\nsí\n".encode("latin-1")))
    (tmp_path / "open.csv.gz").write_bytes(gzip.compress(b'T\n"x\n'))
    scanned = corpus.scan_folder(spark, str(tmp_path), ".csv.gz")
    found = corpus.texts(scanned)
    assert found.count() == 2501 and found.where("label = 'good' and text = 'a\nb'").count() == 1
    reasons = {
        "cut": corpus.UNREADABLE, "not": corpus.UNREADABLE, "crc": corpus.UNREADABLE, "zero": quoted.NO_HEADER,
        "none": quoted.NO_HEADER, "latin": quoted.NOT_TEXT, "open": quoted.UNCLOSED,
    }
    assert rows(corpus.rejects(scanned)) == sorted(reasons.items())
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.csv.bz2").write_bytes(bz2.compress(b"T\none\n"))
    assert rows(corpus.read_folder(spark, str(tmp_path / "b"), ".csv.bz2")) == [("x", "one")]


def test_labels_from_folders(spark, tmp_path):
    for name in ("label=a b", "label=c%3D"):
        (tmp_path / name).mkdir()
        for i in range(2):
            (tmp_path / name / f"part-{i}.csv").write_text(f"T\n{name[-1]}{i}\n")
    found = corpus.read_folder(spark, str(tmp_path), label_folders=True)
    assert rows(found) == [("a b", "b0"), ("a b", "b1"), ("c=", "D0"), ("c=", "D1")]


def test_corpus_workflow(spark, corpora, tmp_path):
    tables = workflows.analyze_corpus(spark, corpora["test"], corpora["train"])
    lexical = {(r.split, r.label): r.vocab_size for r in tables["intra_lexical"].collect()}
    assert lexical == {
        ("test", "pago"): 2, ("test", "saldo"): 4, ("test", "vacío"): 0,
        ("train", "pago"): 2, ("train", "saldo"): 4,
    }
    cohesion = {(r.split, r.label): r.cohesion for r in tables["intra_semantic_cohesion"].collect()}
    assert cohesion["test", "vacío"] is None
    assert all(-1 <= v <= 1 + 1e-9 for v in cohesion.values() if v is not None)
    assert tables["intra_semantic_similarity"].count() == 3 + 1
    assert tables["cross_semantic_similarity"].count() == 2
    assert tables["distribution_emd"].count() == 2
    kurtosis = {r.label: r for r in tables["distribution_kurtosis"].collect()}
    assert set(kurtosis) == {"pago", "saldo", "vacío"}
    assert set(kurtosis["vacío"].asDict().values()) == {"vacío", None}
    out = str(tmp_path / "out")
    workflows.save(tables, out)
    back = spark.read.option("header", True).csv(f"{out}/ttr_inter_set_diff")
    assert back.columns == ["label", "test_ttr", "train_ttr", "type_token_ratio_diff"]
    assert back.count() == 2
    assert spark.read.option("header", True).csv(f"{out}/intra_lexical").where("split = 'test'").count() == 3


def test_own_encoder(spark, corpora):
    def load():
        import numpy as np

        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    frame = corpus.read_corpus(spark, corpora)
    tables = workflows.semantic_tables(frame, load_encoder=load)
    single = tables["intra_semantic_cohesion"].where("split = 'test' and label = 'pago'").first()
    assert single.cohesion == pytest.approx(1.0)


def test_report_workflow(spark, folder, tmp_path_factory):
    processed = workflows.process_reports(spark, folder)
    assert processed["results"].count() == 4
    assert processed["metadata"].count() == 5
    assert processed["preamble"].count() == 8
    assert processed["rejects"].count() == 1
    tables = workflows.evaluate_reports(spark, folder)
    metrics = tables["intent_metrics"]
    assert metrics.columns == ["report", "intent", *intent.METRICS, "model"]
    greet = metrics.where("report = 'M1-RUN_a' and intent = 'Greet'").first()
    assert (greet.precision, greet.recall, greet.support, greet.model) == (1.0, 0.5, 2.0, "M1-RUN")
    entity_rows = rows(tables["entity_metrics"].where("report = 'only header'"))
    assert entity_rows == [
        ("only header", "", 1.0, 0, "only header"),
        ("only header", "micro", 0.0, 0, "only header"),
    ]
    assert tables["entity_methods"].count() == 2
    out = str(tmp_path_factory.mktemp("out"))
    workflows.save(tables, out)
    schema = "intent string, precision double, recall double, f1 double, support double, accuracy double, model string"
    back = files.read_csv(spark, f"{out}/intent_metrics/report=M1-RUN_a", schema)
    assert [r.intent for r in back.collect()] == ["Greet", "none", "micro", "macro"]


def test_json_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([("ñandú \"x\"", 1.5), (None, None)], "name string, value double")
    files.write_json(frame, str(tmp_path / "j"))
    assert rows(files.read_json(spark, str(tmp_path / "j"), frame.schema)) == rows(frame)
    written = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "j").glob("part-*"))
    assert "ñandú" in written and '"name":null' in written
    (tmp_path / "pretty.json").write_text('[\n  {"name": "a",\n   "value": 2.0}\n]', encoding="utf-8")
    got = files.read_json(spark, str(tmp_path / "pretty.json"), frame.schema, multi_line=True)
    assert rows(got) == [("a", 2.0)]


def test_csv_round_trip(spark, tmp_path):
    frame = spark.createDataFrame(
        [("a", 'say "hi", you', 1), ("b", "two\nlines", 2), ("b", None, 3), ("b", " blanks  ", 4)], "k string, t string, n int"
    )
    files.write_csv(frame, str(tmp_path / "c"), ["k"])
    back = files.read_csv(spark, str(tmp_path / "c"), "t string, n int, k string")
    assert rows(back.select("k", "t", "n"), "n") == rows(frame, "n")
