"""Edge cases of the training-data operators, against brute force on small fixtures."""

import base64
import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from gleanframe.llm import language, severity
from gleanframe.llm.decontaminate import benchmark_matches, clean_documents
from gleanframe.llm.located import joined
from gleanframe.llm.mixing import mix, mixed_rows, word_count
from gleanframe.llm.ngram_join import banding, near_classes, one_of_each
from gleanframe.llm.passages import repeated_passages
from gleanframe.llm.privacy import private_spans, sanitised
from gleanframe.llm.secrets import secret_spans
from gleanframe.llm.sharding import byte_size, shard
from gleanframe.llm.vector_copies import close_vectors

# Columns that clash with names the operators use.
DOCS = "doc_id long, text string, source string, n_words long, shard int, row string, k1 long, sig string"


def docs_of(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, ["a", None, "b"][i % 3], 1, 2, "x", 3, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, size):
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 5003}" for i in range(size))


LONG = prose(5, 20_000)
TEXTS = [None, "", "   \n", "one", prose(1, 60), prose(1, 60), prose(1, 59) + " changed", prose(2, 80),
         "x " + prose(2, 80)[:200], prose(3, 40), prose(3, 40) + " " + prose(4, 50), LONG, LONG + " end", "é ü 😀 " * 12]


def grams(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))} if words else set()


def brute_classes(texts):
    sets = [grams(t) for t in texts]
    links = [{j for j, b in enumerate(sets) if j != i and a and b and len(a & b) >= 0.8 * len(a | b)} for i, a in enumerate(sets)]
    root = list(range(len(texts)))
    for _ in texts:
        root = [min([root[i], *[root[j] for j in links[i]]]) for i in range(len(texts))]
    return [(i, root[i], len(links[i])) for i in range(len(texts))]


def test_ngram_join(spark):
    found = near_classes(docs_of(spark, TEXTS)).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, found)) == brute_classes(TEXTS)


def test_ngram_join_splits_large_groups(spark):
    base = prose(9, 200).split()
    texts = [" ".join([*base[:i], "edit", *base[i + 1 :]]) for i in range(40)]
    found = near_classes(docs_of(spark, texts), block_rows=4).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, found)) == brute_classes(texts)


def test_banding_reaches_its_recall():
    bands, rows = banding(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995
    with pytest.raises(ValueError):
        banding(0.01, 0.999999, hashes=2)


def test_one_of_each(spark):
    docs = docs_of(spark, TEXTS).unionByName(docs_of(spark, TEXTS[4:6])).unionByName(docs_of(spark, [prose(1, 60)], [None]))
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    first = {c for _, c, _ in brute_classes(TEXTS)}
    ids = [r["doc_id"] for r in kept.collect()]
    # Texts 4 and 5 come again under the ids 0 and 1, so 0 is now the smallest id of their class, beside the null text's own 0.
    assert sorted(i for i in ids if i is not None) == sorted([*(first - {4}), 0])
    assert None not in ids


def test_repeated_passages(spark):
    texts = [*TEXTS, "a " * 50, prose(2, 80) + " tail"]
    found = {r["doc_id"]: r for r in repeated_passages(docs_of(spark, texts)).collect()}
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = {}
    for d, own in enumerate(words):
        for p in range(len(own) - 34):
            seen.setdefault(tuple(own[p : p + 35]), []).append((d, p))
    gone = [set() for _ in texts]
    for spots in seen.values():
        if len(spots) > 1:
            for d, p in spots:
                gone[d] |= set(range(p, p + 35))
    for d, own in enumerate(words):
        kept = " ".join(w for i, w in enumerate(own) if i not in gone[d])
        row = found[d]
        assert (row["n_words"], row["n_removed"], row["kept_sha256"]) == (
            len(own), len(gone[d]), hashlib.sha256(kept.encode()).hexdigest()), d
        assert sum(s["last"] - s["first"] + 1 for s in row["spans"]) == len(gone[d])


def test_decontamination(spark):
    item = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu"
    bench = spark.createDataFrame([(7, item), (8, "Short item!"), (None, "nine ten"), (9, None), (10, "..."), (7, item)],
                                  "item_id long, text string")
    texts = ["x " + item.upper() + " y", "a short ITEM here", "nine, ten", None, "", "Alpha beta gamma delta", LONG,
             item + " " + item]
    docs = docs_of(spark, texts)
    found = {r["row"]["doc_id"]: r for r in benchmark_matches(docs, bench).collect()}
    assert [found[i]["n_hit"] for i in range(len(texts))] == [12, 2, 2, 0, 0, 0, 0, 24]
    assert {(m["item_id"], m["words"]) for m in found[7]["matches"]} == {(7, 12)}
    # The same in many blocks, behind the bitmap of windows.
    split = {r["row"]["doc_id"]: r for r in benchmark_matches(docs, bench, block_bytes=20).collect()}
    assert len(split) == len(texts)
    for i, r in found.items():
        by = lambda x: sorted(map(str, x["matches"]))
        assert (split[i]["n_words"], split[i]["n_hit"], by(split[i])) == (r["n_words"], r["n_hit"], by(r))
    assert benchmark_matches(docs.limit(0), bench, block_bytes=20).count() == 0
    kept = clean_documents(docs, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6] and kept.columns == docs.columns
    assert benchmark_matches(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_mixing(spark):
    docs = docs_of(spark, TEXTS).withColumn("size", word_count(F.col("text"))).withColumn("target", F.lit("clash"))
    rows = mix(docs).collect()
    total = {s: sum(r["size"] for r in rows if r["source"] == s) for s in ("a", "b", None)}
    for source, all_words in total.items():
        own = [r for r in rows if r["source"] == source]
        assert {r["source_size"] for r in own} == {all_words} and len({r["target"] for r in own}) == 1
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in own)
    assert abs(sum({r["source"]: r["target"] for r in rows}.values()) - 1.5 * sum(total.values())) < 1e-6
    assert sorted(map(str, rows)) == sorted(map(str, mix(docs).collect()))
    assert mixed_rows(docs).columns == docs.columns
    assert mix(docs.limit(0)).count() == 0


def test_sharding(spark):
    docs = docs_of(spark, TEXTS * 3, [i % 7 if i % 5 else None for i in range(3 * len(TEXTS))])
    sized = docs.withColumn("size", byte_size(F.col("text")))
    rows = shard(sized, 4).collect()
    assert len(rows) == 3 * len(TEXTS)
    largest, total = max(r["size"] for r in rows), sum(r["size"] for r in rows)
    for s in range(4):
        own = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 4) <= largest
    assert shard(sized.limit(0), 4).count() == 0


def test_shard_count_beyond_rows(spark):
    rows = shard(docs_of(spark, ["a", "b"]).withColumn("size", F.lit(9).cast("long")), 24).collect()
    assert {r["slot"] for r in rows} == {0} and len({r["shard"] for r in rows}) == 2


def luhn(digits):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def digits(found):
    return re.sub("[^0-9]", "", found)


PRIVATE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m[0])) <= 15),
}
SECRET = {
    "assign": (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
               lambda m: len(m[2]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
}


def brute_spans(text, kinds):
    spans = sorted((m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, (p, ok)) in enumerate(kinds.items())
                   for m in re.finditer(p, text or "", re.ASCII) if ok(m))
    return ",".join(s[2] for s in spans)


TRICKY = [
    None, "", "no data", "😀é a.b+c@d-e.f.g, x@y@z.w q@r", "a@b.c_d@e.f.g@h.i a@b..c @x.y .@-.-",
    "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255 1.2.3 1..2.3.4.5", "4111 1111 1111 1111 x 4111-1111-1111-1112 0000000000000",
    "4111  1111 +1 (017) 555-7713 +12 3 ++49 30 1234567- +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 +1((((((( 9",
    "9" * 5000 + " " + "1 " * 3000, "a" * 30_000 + "@", "x@y" + ".c" * 4000, "a@b.c " * 700,
    'Token = "abcdef" token==a=bcde API_KEY:\'123456\' apikey=12345 passwd :: secretive password=é secret: token=abcdef',
    "AKIA" + "A" * 16 + " XAKIAAKIA" + "B2" * 8 + " AKIA123", "0123456789abcdef01234567 " + "f" * 23 + " g" + "e" * 24 + "X",
    "q8Zk2LmP0vXy7RtB5nWd and AbCdEfGhIjKlMnOpQrStUv",
]


@pytest.mark.parametrize("operator, kinds", [(private_spans, PRIVATE), (secret_spans, SECRET)])
def test_base_spans(spark, operator, kinds):
    found = operator(docs_of(spark, TRICKY)).select("doc_id", joined(F.col("base")).alias("s")).collect()
    assert {r["doc_id"]: r["s"] for r in found} == {i: brute_spans(t, kinds) for i, t in enumerate(TRICKY)}
    assert operator(docs_of(spark, [])).count() == 0


def test_random_strings_are_secrets(spark):
    # The labelled samples must be of the kind looked for: mixed case and digits.
    known = [f"token = {base64.b64encode(hashlib.sha256(str(i).encode()).digest()).decode()}" for i in range(30)]
    texts = [*known, "see Zq8Zk2LmP0vXy7RtB5nWdK3 there", "snake_case_identifier_number_1 and more words here"]
    # And there must be ordinary text to count the other model on.
    texts += ["ordinary words of running text with several identifiers like row_number and batch_size " * 5] * 40
    found = {r["doc_id"]: r["random"] for r in secret_spans(docs_of(spark, texts)).collect()}
    assert [s["found"] for s in found[30]] == ["Zq8Zk2LmP0vXy7RtB5nWdK3"] and found[31] == [] and found[0] == []


def test_random_strings_of_any_kind(spark):
    """Recall on bare random strings of twelve to forty characters, with and without digits, and no false alarm on ordinary ones."""
    import random

    draw = random.Random(11)
    kinds = ["abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    made = ["".join(draw.choice(kinds[i % 2]) for _ in range(draw.randrange(12, 40))) for i in range(200)]
    plain = ["international", "representatives", "row_number_of_batch", "configuration-file", "DataFrameWriter", "2024-01-01T00:00:00",
             "https//example.org/path/to/page.html", "responsibilities", "org.apache.spark.sql.functions", "1234567890123"]
    prose = ("The international representatives read the configuration-file of the DataFrameWriter in org.apache.spark.sql.functions "
             "on 2024-01-01T00:00:00 at https//example.org/path/to/page.html and wrote row_number_of_batch 1234567890 times . ")
    known = [f"token = {''.join(draw.choice(kinds[0]) for _ in range(32))}" for _ in range(300)]
    texts = [f"see {m} there" for m in made] + [f"see {p} there" for p in plain] + known + [prose * 3] * 60
    found = {r["doc_id"]: r["random"] for r in secret_spans(docs_of(spark, texts)).collect()}
    recall = sum(any(s["found"] == m for s in found[i]) for i, m in enumerate(made)) / len(made)
    assert recall >= 0.9
    assert not any(found[len(made) + i] for i in range(len(plain)))


def test_disclosing_terms(spark):
    holders = [f"zorblatt writes from zed@mail.example.org about topic{i} today" for i in range(4)]
    texts = [*holders, *[f"other words about topic{i} today" for i in range(40)], "zorblatt alone"]
    docs = docs_of(spark, texts)
    rows = {r["doc_id"]: r for r in private_spans(docs).join(docs.select("doc_id", "text"), "doc_id").withColumn(
        "clean", sanitised(F.col("text"), F.array_sort(F.concat("base", "terms")))).collect()}
    assert "zorblatt" in {s["found"] for s in rows[0]["terms"]}
    assert not {"today", "about"} & {s["found"] for s in rows[0]["terms"]}
    assert rows[10]["terms"] == [] and rows[44]["terms"] == []
    assert "zorblatt" not in rows[0]["clean"] and "[EMAIL]" in rows[0]["clean"] and rows[10]["clean"] == texts[10]


def flagged_terms(spark, texts, **how):
    return {r["doc_id"]: {s["found"] for s in r["terms"]} for r in private_spans(docs_of(spark, texts), **how).collect()}


def test_rare_and_copied_entities_are_judged(spark):
    plain = [f"other words about topic{i % 20} today" for i in range(400)]
    once = "Bob Zyx about topic1 today bob.z@mail.example.org"
    copied = "quorn about today +49 30 1234567"
    found = flagged_terms(spark, [once, *[copied] * 30, *plain])
    assert "quorn" in found[1] and found[1] == found[30]
    # One meeting is no evidence; three of three are.
    assert not found[0] and {"Bob", "Zyx"} <= flagged_terms(spark, [once] * 3 + plain)[0]
    assert not {"about", "today", "topic1"} & found[1] and not any(found[i] for i in range(31, 431))


def test_disclosure_does_not_follow_the_size_of_the_corpus(spark):
    small = [f"zorblatt writes about topic{i} today zed@mail.example.org" for i in range(4)]
    small += ["Zorblatt alone", *["quorn sends a list from 10.1.2.3"] * 3, "unrelated gizmo appears once today note a@b.example.net",
              "twice seen thing c@d.example.org", "twice seen thing c@d.example.org again"]
    seen = [flagged_terms(spark, [*small, *[f"other words about topic{i % 20} today from a list" for i in range(n)]], everywhere=True)
            for n in (300, 3000, 30_000)]
    for found in seen:
        assert [found[i] for i in range(len(small))] == [seen[0][i] for i in range(len(small))]
    assert "zorblatt" in seen[0][0] and "quorn" in seen[0][5] and not seen[0][8] and not seen[0][9]


def test_terms_are_removed_from_all_documents(spark):
    plain = [f"other words about topic{i % 20} today" for i in range(400)]
    holders = [f"zorblatt writes about topic{i} today zed@mail.example.org" for i in range(4)]
    texts = [*holders, "Zorblatt alone", *["li today 10.1.2.3"] * 3, *plain, None, ""]
    found = flagged_terms(spark, texts, everywhere=True)
    assert "zorblatt" in found[0] and found[4] == {"Zorblatt"} and found[5] == {"li"}
    assert not any(found[i] for i in range(8, len(texts)))


def test_close_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.standard_normal((30, 16))
    near = base + 0.02 * rng.standard_normal(base.shape)
    values = [*base.tolist(), *near.tolist(), base[0].tolist(), (2 * base[1]).tolist()]
    rows = [(i, v, i % 30 % 2) for i, v in enumerate(values)]
    bad = [(100, None, 0), (101, [], 0), (102, [0.0] * 16, 0), (103, [float("nan")] * 16, 0), (104, base[0].tolist(), None),
           (105, [None, *base[0].tolist()[1:]], 0), (106, base[0].tolist()[:8], 0)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int").withColumn("sig", F.lit("x"))
    found = {r["vec_id"]: r for r in close_vectors(table, block_rows=8).collect()}
    unit = np.array(values) / np.linalg.norm(values, axis=1)[:, None]
    linked = (unit @ unit.T >= 0.98) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows]))
    assert [found[i]["n_links"] for i in range(len(values))] == (linked.sum(axis=1) - 1).tolist()
    assert found[30]["component_id"] == 0 and not found[30]["kept"] and found[0]["kept"]
    assert all(found[i]["n_links"] == 0 and found[i]["kept"] for i in range(100, 107))


def test_language(spark):
    words = {"en": "the and of with house tree running water", "de": "der und von mit haus baum laufen wasser",
             "fr": "le et de avec maison arbre courir eau"}
    texts, langs = [], []
    for i in range(90):
        lang = list(words)[i % 3]
        own = words[lang].split()
        texts.append(" ".join(own[(i * k + k * k) % len(own)] for k in range(12)))
        langs.append(lang)
    rows = [(i, t, g) for i, (t, g) in enumerate(zip(texts, langs))] + [(200, None, "en"), (201, "12 34", None), (202, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    model = language.fit(docs.where("doc_id < 60 or doc_id >= 200"))
    found = {r["row"]["doc_id"]: r for r in language.identified(docs, model).collect()}
    assert sum(found[i]["lang_pred"] == langs[i] for i in range(60, 90)) >= 28
    assert {found[i]["lang_pred"] for i in (200, 201, 202)} == {"und"} and found[201]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert language.fit(docs.limit(0)) is None
    assert language.identified(docs, None).where("lang_pred <> 'und'").count() == 0


def test_severity(spark):
    rows, labels = [], []
    for i in range(200):
        bad = i % 4 == 0
        rows.append((i, prose(i, 60) + (" idiot scum" + " trash" * (i % 3) if bad else ""), "x"))
        labels.append((i, int(bad)))
    rows += [(900, None, "x"), (901, "", "x"), (902, "You IDIOT, scum!", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, severity string")
    table = spark.createDataFrame([*labels, (None, 1), (5, None), (902, None)], "doc_id long, toxic int")
    model = severity.fit(docs, table)
    found = {r["row"]["doc_id"]: r for r in severity.graded(docs, model).collect()}
    assert all(found[i]["toxic"] == (i % 4 == 0) for i in range(200))
    assert found[902]["toxic"] and not found[900]["toxic"] and not found[901]["toxic"]
    assert found[902]["expected_severity"] > found[1]["expected_severity"]
    assert len(model.cuts) == 1
    parted = severity.fit(docs, table, split_top=True)
    assert (sorted(parted.cuts) == list(parted.cuts)) and len(parted.cuts) == 2
    assert severity.graded(docs, severity.fit(docs, table.limit(0))).where("toxic").count() == 0


def test_ordered_grades(spark):
    rows = [(i, prose(i, 30) + " awful" * (i % 3 > 0) + " vile" * (i % 3 > 1)) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    grades = spark.createDataFrame([(i, i % 3) for i in range(240)], "doc_id long, grade int")
    model = severity.fit(docs, grades, grade="grade")
    assert len(model.cuts) == 2
    found = {r["row"]["doc_id"]: r["severity"] for r in severity.graded(docs, model).collect()}
    assert sum(found[i] == i % 3 for i in range(240)) >= 230
    unseen = severity.held_out(docs, grades, grade="grade").orderBy("grade").collect()
    rose = [r["expected_severity"] for r in unseen]
    assert [r["grade"] for r in unseen] == [0, 1, 2] and rose == sorted(rose) and 20 < sum(r["n_rows"] for r in unseen) < 90
    assert unseen[0]["n_rejected"] == 0 and all(r["n_rejected"] == r["n_rows"] for r in unseen[1:])


def test_severity_of_long_repeated_and_absent_rows(spark):
    rows = [(i, prose(i, 30) + " scum" * (i % 3 == 0)) for i in range(150)]
    words = " ".join(f"w{i}x" for i in range(60_000))
    rows += [(500, words), (501, words + " scum"), (7, None), (None, "scum"), (502, "scum"), (502, "scum")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*[(i, int(i % 3 == 0)) for i in range(150)], (500, 0), (501, 1)], "doc_id long, toxic int")
    model = severity.fit(docs, labels, text_features=500)
    out = [(r["row"]["doc_id"], r["toxic"]) for r in severity.graded(docs, model).collect()]
    assert len(out) == len(rows)
    assert (500, False) in out and (501, True) in out and (None, True) in out and out.count((502, True)) == 2
    empty = docs.limit(0)
    assert severity.graded(empty, model).count() == 0 == severity.graded(empty, severity.fit(empty, labels)).count()
    assert severity.held_out(empty, labels).count() == 0 == severity.held_out(docs, labels.limit(0)).count()


def test_checksums_match_zlib(spark):
    row = docs_of(spark, ["é😀"]).select(F.crc32(F.col("text").cast("binary")).alias("c")).first()
    assert row["c"] == zlib.crc32("é😀".encode())
