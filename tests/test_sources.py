import json
import os

import pytest
from pyspark.sql import functions as F

from axonframe.operators import labels, merge, records
from axonframe.sources import neurons, texts
from axonframe.sources.neuron_files import write_neuron_files


def write(path, content):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(content if isinstance(content, str) else json.dumps(content))


RECORD = {"tokens": ["a", "b"], "activations": [0.5, -1.0], "dataclass_name": "ActivationRecord"}


def neuron(layer, index, **extra):
    return {
        "neuron_id": {"layer_index": layer, "neuron_index": index, "dataclass_name": "NeuronId"},
        "random_sample": [RECORD], "random_sample_by_quantile": None, "quantile_boundaries": None,
        "mean": 0.25, "variance": None, "skewness": None, "kurtosis": None,
        "most_positive_activation_records": [RECORD, RECORD], "dataclass_name": "NeuronRecord", **extra,
    }


def test_foreign_tree_is_read(spark, tmp_path):
    """Pretty-printed files below neurons/<layer>/, with stray names in between."""
    for layer, index in ((0, 3), (0, 10), (2, 1)):
        write(f"{tmp_path}/neurons/{layer}/{index}.json", json.dumps(neuron(layer, index), indent=1))
    write(f"{tmp_path}/neurons/0/notes.json", "{}")
    write(f"{tmp_path}/extract.log", "done")
    table = neurons.read_neuron_records(spark, str(tmp_path))
    keys = [(r["layer"], r["neuron"]) for r in records.neuron_keys(table).collect()]
    assert keys == [(0, 3), (0, 10), (2, 1)]
    assert neurons.neuron_exists(table, 0, 10) and not neurons.neuron_exists(table, 1, 0)
    row = table.where("neuron = 10").first()
    assert row["variance"] is None and row["neuron_id"]["neuron_index"] == 10
    rows = neurons.record_rows(table.where("layer = 2")).collect()
    assert sorted((r["kind"], r["rank"]) for r in rows) == [("random", 1), ("top", 1), ("top", 2)]


@pytest.mark.parametrize("content", [{"tokens": ["a"], "activations": [1.0], "dataclass_name": "ActivationRecord"}, "[1, 2]", "no json"])
def test_other_objects_are_rejected(spark, tmp_path, content):
    write(f"{tmp_path}/0/1.json", content)
    with pytest.raises(Exception, match="not a neuron record|cannot read"):
        neurons.read_neuron_records(spark, str(tmp_path)).collect()


def test_round_trip(spark, make_acts, tmp_path):
    table = make_acts({(0, 0): [[1.0, 2.0], [], [0.5]], (1, 4): [[3.0]]})
    kept = records.neuron_records(table, 2, 3, (0.5,), 2)
    boundaries = records.quantile_boundaries(records.record_index(table), (0.5,))
    neurons.write_neuron_records(neurons.to_neuron_records(kept, records.moments(table), boundaries), str(tmp_path))
    back = neurons.read_neuron_records(spark, f"{tmp_path}/neurons")
    row = back.where("layer = 1").first()
    assert row["mean"] == 3.0 and row["variance"] is None
    assert [r["activations"] for r in row["most_positive_activation_records"]] == [[3.0]]
    first = back.where("layer = 0").first()
    assert [r["activations"] for r in first["most_positive_activation_records"]] == [[1.0, 2.0], [0.5]]
    assert len(first["random_sample"]) == 3 and len(first["quantile_boundaries"]) == 1
    assert sum(map(len, first["random_sample_by_quantile"])) == 3


def test_lines_layout(spark, make_acts, tmp_path):
    table = make_acts({(0, n): [[1.0 + n]] for n in range(5)})
    kept = records.neuron_records(table, 2, 0, None)
    nested = neurons.to_neuron_records(kept, records.moments(table))
    neurons.write_neuron_records(nested, str(tmp_path), one_file_each=False)
    back = neurons.read_neuron_lines(spark, f"{tmp_path}/neurons")
    assert sorted((r["neuron"], r["mean"]) for r in back.collect()) == [(n, 1.0 + n) for n in range(5)]


def explanation(text, score):
    return {"explanation": text, "scored_simulation": {"scored_sequence_simulations": [], "ev_correlation_score": score}}


def test_explanations(spark, tmp_path):
    one = json.dumps({"neuron_id": {"layer_index": 0, "neuron_index": 1}, "scored_explanations": [explanation("x", 0.5), explanation("y", None)]})
    write(f"{tmp_path}/0/1.jsonl", one + "\n")
    write(f"{tmp_path}/0/2.jsonl", one + "\n" + one + "\n")
    loose = neurons.read_explanations(spark, str(tmp_path))
    rows = neurons.explanation_rows(loose.where("neuron = 1")).orderBy("explanation_id").collect()
    assert [(r["explanation"], r["ev_correlation_score"]) for r in rows] == [("x", 0.5), ("y", None)]
    assert loose.count() == 2
    with pytest.raises(Exception, match="expected one line"):
        neurons.read_explanations(spark, str(tmp_path), strict=True).collect()


def test_token_tables_are_read_strictly(spark, tmp_path):
    side = {"tokens": ["p", "q"], "strengths": [2.0, 1.0]}
    whole = {f"{d}_{s}": side for d in ("input", "output") for s in ("positive", "negative")}
    write(f"{tmp_path}/w/0/1.json", {**whole, "dataclass_name": "WeightBasedSummaryOfNeuron"})
    rows = neurons.read_token_weights(spark, f"{tmp_path}/w").collect()
    assert len(rows) == 8 and {(r["rank"], r["token"], r["strength"]) for r in rows} == {(1, "p", 2.0), (2, "q", 1.0)}
    write(f"{tmp_path}/v/0/1.json", whole)
    with pytest.raises(Exception, match="not a WeightBasedSummaryOfNeuron"):
        neurons.read_token_weights(spark, f"{tmp_path}/v").collect()
    write(f"{tmp_path}/a/0/1.json", {"tokens": ["z"], "average_activations": [0.5], "dataclass_name": "TokenLookupTableSummaryOfNeuron"})
    assert neurons.read_token_averages(spark, f"{tmp_path}/a").first()["avg_activation"] == 0.5


def test_related_with_a_missing_direction(spark, tmp_path):
    lists = {"top_positive_neurons": ["3_40", "7_1"], "top_positive_weights": [2.0, 1.0], "top_negative_neurons": [], "top_negative_weights": []}
    write(f"{tmp_path}/0/1.json", {"c_proj": lists, "c_fc": None})
    rows = neurons.read_related(spark, str(tmp_path)).orderBy("rank").collect()
    assert [(r["direction"], r["rank"], r["to_layer"], r["to_neuron"], r["weight"]) for r in rows] == [("output", 1, 3, 40, 2.0), ("output", 2, 7, 1, 1.0)]


HEADER = "Argument ID\tConclusion\tStance\tPremise\n"


def test_labelled_texts(spark, tmp_path):
    write(f"{tmp_path}/b.tsv", HEADER + 'B1\tc\tagainst\t  second "quoted" \nB2\tc\tagainst\t   \nB3\tc\tagainst\t"a ""b"" c"\n')
    write(f"{tmp_path}/a.tsv", HEADER + "A1\tc\tagainst\tfirst\n")
    found = texts.read_labelled_texts(spark, str(tmp_path), ["b.tsv", "a.tsv"]).orderBy("split_no", "row_no").collect()
    assert [r["text"] for r in found] == ['second "quoted"', 'a "b" c', "first"]
    with pytest.raises(FileNotFoundError):
        texts.read_labelled_texts(spark, str(tmp_path), ["c.tsv"])
    with pytest.raises(ValueError, match="Summary"):
        texts.read_labelled_texts(spark, str(tmp_path), ["a.tsv"], "Summary")


def test_quoted_line_breaks_are_kept(spark, tmp_path):
    write(f"{tmp_path}/a.tsv", HEADER + 'A1\tc\tagainst\t"one\ntwo"\nA2\tc\tagainst\tthree\n')
    found = texts.read_labelled_texts(spark, str(tmp_path), ["a.tsv"]).orderBy("row_no").collect()
    assert [(r["row_no"], r["text"]) for r in found] == [(0, "one\ntwo"), (1, "three")]


def test_row_order_survives_file_splits(spark, tmp_path):
    lines = [f"A{i}\tc\tagainst\tp{i}" for i in range(5000)]
    write(f"{tmp_path}/a.tsv", HEADER + "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        found = texts.read_labelled_texts(spark, str(tmp_path), ["a.tsv"]).orderBy("split_no", "row_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["text"] for r in found] == [f"p{i}" for i in range(5000)]


def test_labels_metadata_and_joins(spark, tmp_path):
    write(f"{tmp_path}/l.tsv", "Argument ID\tcare: kind\tpower: rich\nA1\t1\t0\nA2\t0\t0\n")
    write(f"{tmp_path}/m.tsv", "Argument ID\tURL\tInternet Archive Timestamp\nA1\thttp://x\t20210402030405\n")
    tree = {"Care": {"care: kind": ["be kind", "help"], "care: warm": ["be warm"]}, "Power": {"power: rich": ["be rich"]}}
    write(f"{tmp_path}/t.json", json.dumps(tree, indent=2))
    wide = texts.read_labels(spark, f"{tmp_path}/l.tsv")
    long = labels.unpivot_labels(wide, ["argument_id"])
    assert long.count() == 4
    taxonomy = texts.read_taxonomy(spark, f"{tmp_path}/t.json")
    assert taxonomy.count() == 4
    rolled = {(r["argument_id"], r["level2"]): r["value"] for r in labels.roll_up(long, taxonomy, ["argument_id"]).collect()}
    assert rolled == {("A1", "Care"): 1, ("A1", "Power"): 0, ("A2", "Care"): 0, ("A2", "Power"): 0}
    meta = texts.read_metadata(spark, f"{tmp_path}/m.tsv", stamp="Internet Archive Timestamp")
    joined = labels.join_arguments(wide, wide.select("argument_id", F.lit(1).alias("x")), meta)
    stamps = {r["argument_id"]: r["Internet Archive Timestamp"] for r in joined.collect()}
    assert stamps["A2"] is None and stamps["A1"].isoformat() == "2021-04-02T03:04:05"


def test_puzzles(spark, tmp_path):
    puzzle = {"p": {"name": "p", "explanation": "e", "false_explanations": ["f", "g"], "sentences": [["a", ["b", 2], '["c"', "1"], [["d", 0.5]]]}}
    table = spark.createDataFrame([(json.dumps(puzzle),)], "value STRING")
    rows = texts.puzzle_rows(table).orderBy("sentence_no").collect()
    assert rows[0]["tokens"] == ["a", "b", '["c"', "1"] and rows[0]["activations"] == [0.0, 2.0, 0.0, 0.0]
    assert rows[1]["tokens"] == ["d"] and rows[1]["false_explanations"] == ["f", "g"]
    puzzle["p"]["sentences"] = [[[3, 1.0]]]
    with pytest.raises(Exception, match="no string"):
        texts.puzzle_rows(spark.createDataFrame([(json.dumps(puzzle),)], "value STRING")).collect()


FIELDS = {"C": ["ints"], "CExt": ["ints", "s"], "B": ["str_to_c", "cs"], "D": ["s1", "s2"]}


@pytest.mark.parametrize("text,kind", [
    ('{"ints": [3], "dataclass_name": "C"}', "C"), ('{"ints": [3]}', "C"), ('{"ints": [3], "s": "t"}', "CExt"), ('{"s1": "t"}', "D"),
    ('{"other": 1}', None), ('{"ints": [3], "dataclass_name": "Unknown"}', None), ("{}", None),
])
def test_record_types_are_resolved(spark, text, kind):
    table = spark.createDataFrame([(text,)], "v STRING")
    assert table.select(texts.resolve_tag(F.col("v"), FIELDS)).first()[0] == kind


def test_strict_types_and_field_checks(spark):
    one = lambda text: spark.createDataFrame([(text,)], "v STRING")
    assert one('{"s1": "t"}').select(texts.resolve_tag(F.col("v"), FIELDS, strict=True)).first()[0] is None
    with pytest.raises(Exception, match="unknown record type"):
        one('{"dataclass_name": "Z"}').select(texts.resolve_tag(F.col("v"), FIELDS, strict=True)).collect()
    check = texts.check_fields(F.col("v"), ["s1", "s2"], ["s1"])
    assert one('{"s1": "t", "dataclass_name": "D"}').select(check).first()[0]
    with pytest.raises(Exception, match="unknown fields: x"):
        one('{"s1": "t", "x": 1}').select(check).collect()
    with pytest.raises(Exception, match="missing fields: s1"):
        one('{"s2": "t"}').select(check).collect()


def test_typed_objects(spark):
    types = {"A": "tokens ARRAY<STRING>, size INT", "B": "name STRING, inner STRUCT<x: DOUBLE>"}
    data = [
        '{"dataclass_name": "A", "tokens": ["a", null], "size": 2}', '{"tokens": []}', '{"name": "n", "inner": {"x": 1, "dataclass_name": "C"}}',
        '{"name": null, "inner": null}', '{"z": [1]}', '{"dataclass_name": "Z", "size": 1}', '[1]', "{}", None,
    ]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "kind_no INT, value STRING")
    read = texts.typed_objects(rows, types, {"A": {"size": F.lit(7)}})
    found = {r["kind_no"]: r for r in read.withColumn("other", F.to_json("other")).collect()}
    assert tuple(found[0]["A"]) == (["a", None], 2) and tuple(found[1]["A"]) == ([], 7)
    assert found[2]["B"]["inner"]["x"] == 1.0 and found[2]["A"] is None and found[2]["kind"] == "B"
    assert tuple(found[3]["B"]) == (None, None)
    assert [found[i]["kind"] for i in range(4, 9)] == [None] * 5
    assert [found[i]["other"] for i in range(4, 9)] == ['{"z":[1]}', '{"dataclass_name":"Z","size":1}', "[1]", "{}", None]
    assert texts.typed_objects(rows.limit(0), types).count() == 0
    one = lambda text: texts.typed_objects(spark.createDataFrame([(text,)], "value STRING"), types).collect()
    with pytest.raises(Exception, match="missing fields: size"):
        one('{"tokens": ["a"]}')
    with pytest.raises(Exception, match="unknown fields: more"):
        one('{"dataclass_name": "A", "tokens": [], "size": 1, "more": 2}')
    with pytest.raises(Exception, match="INVALID_VARIANT_CAST"):
        one('{"dataclass_name": "A", "tokens": [], "size": "x"}')


def test_generic_texts(spark, tmp_path):
    write(f"{tmp_path}/t.json", '{"text": " a "}\n{"text": "  "}\n{"text": null}\n{"other": 1}\n')
    assert [r["text"] for r in texts.read_texts(spark, f"{tmp_path}/t.json", "json").collect()] == [" a "]
    write(f"{tmp_path}/t.txt", "x\n\n y\n")
    assert [r["text"] for r in texts.read_texts(spark, f"{tmp_path}/t.txt", "text").collect()] == ["x", " y"]
    with pytest.raises(ValueError):
        texts.read_texts(spark, f"{tmp_path}/t.json", "json", "other")


def test_objects_and_text_streams(spark, tmp_path):
    write(f"{tmp_path}/o/1.json", '{"a": {"b": [1, 2]}}\n')
    row = texts.read_objects(spark, f"{tmp_path}/o").select(F.variant_get("data", "$.a.b[1]", "int")).first()
    assert row[0] == 2
    write(f"{tmp_path}/o/2.json", '{"a": 1}\n{"a": 2}\n')
    with pytest.raises(Exception, match="expected one line"):
        texts.read_objects(spark, f"{tmp_path}/o").collect()
    write(f"{tmp_path}/s/1.json", '{"text": " x "}\n{"text": " "}\n')
    stream = texts.stream_texts(spark, f"{tmp_path}/s", "json", "text STRING")
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True)
    query.start(f"{tmp_path}/out").awaitTermination()
    assert [r["text"] for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [" x "]


def test_named_files_and_merged_trees(spark, make_acts, tmp_path):
    trees = []
    for shard, lists in enumerate(({(0, 1): [[1.0, 3.0], [0.5]], (2, 7): [[-1.0]]}, {(0, 1): [[2.0], []], (10, 0): [[]]})):
        acts = make_acts(lists)
        rows = neurons.to_neuron_records(records.neuron_records(acts, 2, 1, None), records.moments(acts))
        write_neuron_files(rows, f"{tmp_path}/{shard}")
        write_neuron_files(rows, f"{tmp_path}/{shard}")  # Again: files are replaced.
        trees.append(neurons.read_neuron_records(spark, f"{tmp_path}/{shard}/neurons"))
    found = sorted(p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob("*") if p.is_file() and not p.name.endswith(".crc"))
    assert found == ["0/neurons/0/1.json", "0/neurons/2/7.json", "0/neurons/_SUCCESS", "1/neurons/0/1.json", "1/neurons/10/0.json", "1/neurons/_SUCCESS"]
    write_neuron_files(merge.merge_neuron_trees(trees, 2, 1), f"{tmp_path}/all")
    merged = neurons.read_neuron_records(spark, f"{tmp_path}/all/neurons")
    tops = {(r.layer, r.neuron): [x.activations for x in r.most_positive_activation_records] for r in merged.collect()}
    # The record with 3 was fed as a top record and maybe as a sampled one, each time counted.
    assert tops.keys() == {(0, 1), (2, 7), (10, 0)} and tops[2, 7] == [[-1.0], [-1.0]] and tops[10, 0] == []
    assert tops[0, 1][0] == [1.0, 3.0] and tops[0, 1][1] in ([1.0, 3.0], [2.0])
    with pytest.raises(Exception, match="two records of neuron 7 in layer 2"):
        write_neuron_files(trees[0].unionByName(trees[0]).where("neuron = 7"), f"{tmp_path}/twice")
    with pytest.raises(ValueError):
        merge.merge_neuron_trees([])
