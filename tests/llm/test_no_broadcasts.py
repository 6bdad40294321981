"""Near-duplicates: no table goes whole through the driver, however few its bytes, unless its rows are counted and few."""

import random

from noteloom.llm import neardup


def texts():
    """Edited copies of long texts: lists that span several components, short and long ones."""
    r = random.Random(5)
    out = []
    for _ in range(2):
        base = [f"w{r.randrange(10**6)}" for _ in range(60)]
        for _ in range(8):
            words = list(base)
            for _ in range(r.randrange(9)):
                words[r.randrange(len(words))] = f"n{r.randrange(10**6)}"
            out.append(" ".join(words))
    return out


def broadcasts(spark, run):
    """Of the queries that run() starts: how many there are, and the plans, as they ran in the end, that broadcast a table."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    new = store.executionsList(before, store.executionsCount() - before)
    plans = [new.apply(k).physicalPlanDescription() for k in range(new.size())]
    return len(plans), [p for p in plans if "BroadcastExchange" in p]


def test_no_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FEW", -1)
    # an id that two documents have ties their classes
    docs = spark.createDataFrame([(i if i else 13, t) for i, t in enumerate(texts())], "doc_id long, text string")
    monkeypatch.setattr(neardup, "SHORT_LIST", 2)
    n, found = broadcasts(spark, lambda: neardup.near_duplicates(docs).collect())
    assert n > 10 and found == []
