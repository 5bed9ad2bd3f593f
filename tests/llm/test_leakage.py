from lodestream.llm.leakage import find_leaks, leaked_items

ITEM = "The beacon Skambonist blinked 8 times during one watch once 80 signatures had been gathered on behalf of an absent widow while the upper sluice stood open"
OTHER = "Gauge Pekiben lagged 42 ticks behind gauge Todlutak until the sixth lantern is lit and blamed the tide tables for want of a better measure in the almanac"


def run(spark, docs, items=((1, ITEM), (2, OTHER))):
    d = spark.createDataFrame([(*x, "x", 0) for x in docs], "doc_id long, text string, item_id string, share int")
    i = spark.createDataFrame([(*x, "s") for x in items], "item_id long, text string, suite string")
    return {(r["doc_id"], r["item_id"]): r for r in find_leaks(d, i).collect()}


def test_whole_partial_changed_and_scattered(spark):
    words = ITEM.split()
    half = len(words) // 2
    changed = " ".join("zzz" if k % 7 == 3 else w for k, w in enumerate(words))
    docs = [
        (1, "Intro. " + ITEM + " Outro."),
        (2, "> " + ITEM.upper().replace(" ", "\n> ", 9) + "!"),
        (3, changed),
        (4, " ".join(words[: half + 2]) + ". Something else entirely stands here between. " + OTHER),
        (5, " ".join(words[:6]) + " and no more than that"),
        (6, "they spoke of the beacon, the widow and the sluice"),
        (7, None),
        (8, ""),
        (None, ITEM),
        (9, " ".join(words[half:]) + " filler text here " + " ".join(words[:half])),
        (10, "pad " * 100_000 + ITEM),
        (1, "Intro. " + ITEM + " Outro."),
        (11, " ".join(reversed(words))),
        (12, "<p>" + " ".join(words[:10]) + "</p><p>" + " ".join(words[10:]) + "</p>"),
    ]
    got = run(spark, docs)
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 1), (4, 2), (9, 1), (10, 1), (12, 1)}
    one = got[(1, 1)]
    assert docs[0][1][one["start"] : one["end"]] == ITEM and one["share"] == 1.0


def test_empty_tables_and_odd_items(spark):
    assert run(spark, []) == {} and run(spark, [(1, ITEM)], []) == {}
    assert set(run(spark, [(1, ITEM)], [(1, None), (2, ""), (None, ITEM), (3, ITEM), (4, ITEM), (4, ITEM)])) == {(1, 3), (1, 4)}


def test_report(spark):
    d = spark.createDataFrame([(1, ITEM), (2, ITEM)], "doc_id long, text string")
    i = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert [tuple(r) for r in leaked_items(find_leaks(d, i)).collect()] == [(1, 2, 1.0)]
