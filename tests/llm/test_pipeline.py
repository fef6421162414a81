import hashlib
import random

import corpus_pipeline as cp
from quarrylens.llm import mixing

from .test_simhash import similar
from .test_substring import brute as repeats


def test_stages_against_brute_force(spark, tmp_path):
    words = [f"word{i} kot{i % 9}".split()[i % 2] for i in range(500)]
    rows = []
    for i in range(80):
        text = " ".join(words[(i * 31 + j * (i % 5 + 1)) % 500] for j in range(30 + i))
        rows.append((i, text, "en" if i % 2 else None, ["a", "a", "b", None][i % 4], len(text)))
    rows += [(100, rows[3][1], "en", "b", 1), (101, "shared start " + " ".join(rows[4][1].split()[:20]) + " own end", "en", "b", 1), (102, None, "en", "a", 0), (103, "12 34", None, "a", 5), (104, "", None, None, 0)]
    folder = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    state = {d: t for d, t, *_ in rows}
    table = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        table = stage(spark, table, folder)
        assert table.columns == docs.columns
        path = f"{folder}/{name}"
        table.write.parquet(path)
        table = spark.read.parquet(path)
        if name == "language":
            state = {d: t for d, t in state.items() if t and any(c.isalpha() for c in t)}
        elif name == "near_duplicates":
            keep = similar(list(state.items()))
            state = {d: t for d, t in state.items() if d in keep}
        elif name == "substrings":
            left = {d: (n - g, sha) for d, n, g, sha in repeats(list(state.items()))}
            got = {r.doc_id: r.text for r in table.collect()}
            assert set(got) == {d for d, (n, _) in left.items() if n}
            for d, t in got.items():
                assert hashlib.sha256(b" ".join(t.encode().split())).hexdigest() == left[d][1]
            state = got
        assert {r.doc_id: r.text for r in table.collect()} == state
    done = cp.run(spark, folder).collect()
    assert {r.doc_id: r.decoded_sha256 for r in done} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in state.items()}


def test_empty_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_file_and_row_give_the_schedules_order(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, " ".join(f"the{rnd.randrange(10**6)} house{rnd.randrange(10**6)}" for _ in range(600 + 600 * (i % 7))), "en", "aab"[i % 3], 0) for i in range(60)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    cp.mix(spark, docs, "").write.parquet(f"{tmp_path}/mix")
    out, slots = mixing.interleave(docs)
    want = [r.doc_id for r in sorted(out.collect(), key=lambda r: (r["__slot"], r["__shuffle"]))]
    got = cp.encode(spark, spark.read.parquet(f"{tmp_path}/mix"), "").collect()
    assert slots > 4 and len({r.file for r in got}) > 1
    assert [r.doc_id for r in sorted(got, key=lambda r: (r.file, r.row))] == want


def test_stages_with_nulls_repeats_and_clashing_names(spark, tmp_path):
    rnd = random.Random(8)
    text = lambda n: " ".join(f"some{rnd.randrange(10**6)} letters" for _ in range(n))
    a, b = text(40), text(30)
    rows = [(1, a, "en", "s"), (1, b, "en", "s"), (2, a, None, None), (2, a, None, None), (None, b, "en", "s"), (None, None, "en", "s"), (3, text(5), "de", "t"), (4, "", None, "t"), (5, text(20_000), "en", "t")]
    names = "__lang __text __score __id __tag __cut __lo __hi __source __range __slot __shuffle row slot block key tag id text_ size source_".split()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(*r, 0, *names) for r in rows], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        table = stage(spark, table, str(tmp_path))
        assert table.columns == docs.columns
        table.write.parquet(f"{tmp_path}/{name}")
        table = spark.read.parquet(f"{tmp_path}/{name}")
        assert all([r[n] for n in names] == names for r in table.collect())
        if name == "language":
            assert sorted(str(r.doc_id) for r in table.collect()) == ["1", "1", "2", "2", "3", "5", "None"]
    left = sorted((str(r.doc_id), r.text) for r in table.collect())
    assert left == sorted([("1", a), ("1", b), ("None", b), ("3", rows[6][1]), ("5", rows[8][1])])
    assert sorted(str(r.doc_id) for r in cp.encode(spark, table, str(tmp_path)).collect()) == ["1", "1", "3", "5", "None"]
