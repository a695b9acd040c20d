"""Quality rules, mixing and pseudonyms against versions in plain Python."""

import hashlib
import re
from collections import Counter, defaultdict
from datetime import date

import pytest
from pyspark.sql import functions as F

from dayweave.llm import mixing, pii, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _rules(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, repeated = len(words), len(covered)
    failed = n < 50 or 100 * repeated > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeated, failed


TEXTS = [
    "a b c a b c a b c",
    "a b c d a b c d " * 20 + "e",
    "x y\nx y\n\n \nx y \nz#*$%&|<>",
    "l1\nl1\x0bl1\nl1",
    " ".join(f"w{i}" for i in range(60)),
    " ".join(f"w{i % 40}" for i in range(60)),
    "aaa " * 100,
]


def test_rules_of_single_documents(spark, odd, odd_rows, none):
    rows = [(i, t, None) for i, t in enumerate(TEXTS)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id"]).collect()
    assert sorted(tuple(r)[0:1] + tuple(r)[2:] for r in got) == sorted((i, *_rules(t), not _rules(t)[-1]) for i, t, _ in rows)
    got = quality.judge(odd, ["doc_id"]).drop("source").collect()
    counts = sorted(repr(tuple(r)[:-1]) for r in got)
    assert counts == sorted(repr((i, *_rules(t))) for i, t, _ in odd_rows)
    assert quality.judge(none, ["doc_id"]).count() == 0
    assert quality.keep_good(none).columns == none.columns


def _hosts(spark, hosts):
    rows = [(h, i < failed) for h, (n, failed) in hosts.items() for i in range(n)]
    return spark.createDataFrame(rows, "source string, base_failed boolean")


def test_rates_are_shrunk_towards_the_mean(spark):
    rates = quality.host_rates(_hosts(spark, {"big": (200, 190), "small": (2, 2), "clean": (300, 3), "fine": (300, 9)})).collect()
    by_host = {r["source"]: r["rate"] for r in rates}
    assert by_host["big"] > 0.9 and by_host["clean"] < 0.03
    mean = 204 / 802
    assert mean < by_host["small"] < 1


def test_equal_hosts_all_get_the_mean(spark):
    rates = quality.host_rates(_hosts(spark, {f"h{i}": (50, 5) for i in range(9)})).collect()
    assert {round(r["rate"], 12) for r in rates} == {0.1}


def test_a_bad_host_takes_its_good_documents_along(spark):
    good, bad = TEXTS[4], "too short"
    rows = [(i, good if i < 3 else bad, "junk", "x") for i in range(60)]
    rows += [(100 + i, bad if i < 3 else good, f"site{i % 4}", "x") for i in range(200)] + [(900, good, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words string")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r["n_words"] for r in kept.collect()} == {"x"}
    assert {r["doc_id"] for r in kept.collect()} == {*range(103, 300), 900}
    judged = quality.judge(docs, ["doc_id"])
    assert {r["doc_id"] for r in judged.where("kept").collect()} == {*range(103, 300), 900}


def _targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        open_ = sum(weight[s] for s in sizes if s not in capped)
        level = rest / open_ if open_ else 0
        over = {s for s in sizes if s not in capped and level * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else level * weight[s] for s in sizes}
        capped |= over


def _mix(rows):
    sized = [(i, s, len(WORD.findall(t or ""))) for i, t, s in rows]
    total = Counter()
    for _, s, n in sized:
        total[s] += n
    return sized, total, _targets(total)


@pytest.mark.parametrize("kind", ["odd", "uneven"])
def test_mix(spark, odd, odd_rows, kind):
    rows = odd_rows
    if kind == "uneven":
        rows = [(i, "w " * (i % 7), "tiny" if i % 50 == 0 else "zéro" if i % 3 else "a") for i in range(400)]
        rows += [(1, "w", "tiny")] * 40 + [(i, "", "none") for i in range(5)]
    docs = odd if kind == "odd" else spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    sized, total, targets = _mix(rows)
    got = mixing.schedule(docs).collect()
    assert sorted(((r["doc_id"], r["source"], r["size"]) for r in got), key=repr) == sorted(sized, key=repr)
    taken = Counter()
    for r in got:
        assert r["source_size"] == total[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 1
    again = mixing.schedule(docs.repartition(7)).collect()
    key = lambda r: repr((r["source"], r["doc_id"], r["size"], r["start"], r["taken"]))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_the_mix_is_in_the_order_of_finish_times(spark, sf_dir, none):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    served = mixing.mix(docs).collect()
    assert [r["finish"] for r in served] == sorted(r["finish"] for r in served)
    budget = docs.select(F.sum(F.regexp_count("text", F.lit(mixing.word_count.__globals__["WORD"])))).first()[0]
    assert abs(sum(r["words"] for r in served) - budget) <= docs.select("source").distinct().count()
    by_source = defaultdict(list)
    for r in served:
        by_source[r["source"]].append(r["finish"])
    # The last document of every source ends at the end of the budget or is cut there.
    for times in by_source.values():
        assert max(times) >= 0.999
    assert mixing.mix(none).count() == 0 and mixing.schedule(none).count() == 0


def test_mixed_documents_are_whole(spark, sf_dir, odd, none):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    use = {r["doc_id"]: [sum(2 * w >= r["size"] > 0 and w > 0 for w in r["words"])] for r in mixing.schedule(docs).collect()}
    got = Counter(r["doc_id"] for r in mixing.mixed_documents(docs).collect())
    assert {k: v[0] for k, v in use.items() if v[0]} == dict(got)
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    total = sum(sum(2 * w >= r["size"] > 0 and w > 0 for w in r["words"]) for r in mixing.schedule(odd).collect())
    assert mixed.count() == total
    assert mixing.mixed_documents(none).count() == 0


def test_equal_rows_without_id_get_their_uses(spark):
    """Many rows that are alike, and some that differ only in another column."""
    rows = [(None, "one two three", "a", 0)] * 50 + [(None, "one two three", "a", i) for i in range(20)]
    rows += [(i, "w " * 100, "b", 0) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, other long").repartition(6)
    planned = Counter()
    for r in mixing.schedule(docs).collect():
        planned[r["source"]] += sum(2 * w >= r["size"] > 0 and w > 0 for w in r["words"])
    assert planned["a"] % 70
    got = Counter(tuple(r) for r in mixing.mixed_documents(docs).collect())
    assert Counter({s: sum(n for r, n in got.items() if r[2] == s) for s in ("a", "b")}) == planned
    assert got == Counter(tuple(r) for r in mixing.mixed_documents(docs.repartition(3)).collect())


def _luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def _shift(text, digest, hexadecimal):
    out = []
    for i, c in enumerate(text):
        by = int(digest[4 * (i % 32) : 4 * (i % 32) + 4], 16)
        for first, n in (("0", 10), ("a", 6 if hexadecimal else 26), ("A", 6 if hexadecimal else 26)):
            if ord(first) <= ord(c) < ord(first) + (10 if n == 10 else 26):
                c = chr(ord(first) + (ord(c) - ord(first) + by) % n)
                break
        out.append(c)
    return "".join(out)


def _feistel(text, kind, hexadecimal=False, key=pii.KEY):
    a, b = text[: len(text) // 2], text[len(text) // 2 :]
    for i in range(pii.ROUNDS):
        digest = lambda x: hashlib.sha512(f"{key}|{kind}|{i}|{x}".encode()).hexdigest()
        if i % 2 == 0:
            a = _shift(a, digest(b), hexadecimal)
        else:
            b = _shift(b, digest(a), hexadecimal)
    return a + b


def _pseudonymise(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return [(r["text"], r["n_replaced"]) for r in pii.pseudonymise(rows).orderBy("id").collect()]


def test_each_kind_keeps_its_format(spark):
    texts = [
        "mail und.34@mail7.example.com.",
        "+1 (017) 555-7713 x 212-555-0199",
        "4111111111111111 and 4111 1111 1111 1111 not 4111111111111112",
        "7536784127813050 4845168114407329",
        "GB82WEST12345698765432 not GB83WEST12345698765432",
        "123-45-6789 not 000-12-3456 666-12-3456 123-00-4567",
        "235.58.234.215. not 999.1.1.1 or 1.2.3.4.5",
        "2024-02-29 31/12/1999 12/31/1999 01.02.2003 not 2023-02-29 99/99/2000 1492-10-12",
        'TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!! not 9233A8ECF7C5B09FE5949719B6B82BC439E9329B',
    ]
    got = _pseudonymise(spark, texts)
    assert [n for _, n in got] == [1, 2, 2, 2, 1, 1, 1, 4, 1]
    shape = lambda t: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "9", t)))
    for before, (after, _) in zip(texts[:4] + texts[8:], got[:4] + got[8:]):
        assert shape(before) == shape(after) and before != after
        assert before.partition(" not ")[2] == after.partition(" not ")[2]
    plain, spaced = got[2][0].partition(" not ")[0].split(" and ")
    assert plain == spaced.replace(" ", "") and _luhn(plain)
    assert all(map(_luhn, got[3][0].split()))
    assert plain[:-1] == _feistel("411111111111111", "card")
    assert got[0][0] == f"mail {_feistel('und.34', 'email')}@mail7.example.com."
    assert got[1][0].split(" x ")[0] == "+1 ({}{}{}) {}{}{}-{}{}{}{}".format(*_feistel("0175557713", "phone"))
    iban = got[4][0].split()[0]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    days = got[7][0].split()
    iso = date.fromisoformat(days[0])
    assert 1800 <= iso.year < 2200
    d, m, y = map(int, days[1].split("/"))
    m2, d2, y2 = map(int, days[2].split("/"))
    assert date(y, m, d) == date(y2, m2, d2)
    assert days[4:] == texts[7].split()[4:]
    area, group, serial = map(int, got[5][0].split()[0].split("-"))
    assert 0 < area < 900 and area != 666 and group and serial
    assert all(0 <= int(x) <= 255 for x in got[6][0].split()[0].rstrip(".").split("."))


@pytest.mark.parametrize("low, high", [(7, 11), (1, 5), (189, 773)])
def test_numbers_are_permuted(spark, low, high):
    n = low * high
    got = spark.range(n).select(pii.feistel_number(F.col("id"), low, high, "k", "t").alias("x")).collect()
    assert sorted(r["x"] for r in got) == list(range(n))


def test_texts_are_permuted(spark):
    codes = [f"{i:03d}" for i in range(1000)]
    rows = spark.createDataFrame([(c,) for c in codes], "c string")
    got = [r[0] for r in rows.select(pii.feistel_text(F.col("c"), "k", "t")).collect()]
    assert sorted(got) == codes


def test_odd_rows_are_pseudonymised(spark, odd, odd_rows, none):
    got = pii.pseudonymise(odd, count=None)
    assert got.columns == odd.columns
    rows = got.collect()
    assert {r["n_replaced"] for r in rows} == {"other11"}
    changed = sorted({r["text"] for r in rows if r["text"]} - {t for _, t, _ in odd_rows if t})
    assert len(changed) == 1 and "7713" not in changed[0] and "und.34" not in changed[0]
    assert sum(r["text"] is None for r in rows) == 2
    assert pii.pseudonymise(none).count() == 0


def test_equal_values_stay_linked(spark):
    got = _pseudonymise(spark, ["x und.34@a.org y", "und.34@b.net", "UND.34@a.org"])
    names = [re.search(r"(\S+)@", t)[1] for t, _ in got]
    assert names[0] == names[1] != names[2]
