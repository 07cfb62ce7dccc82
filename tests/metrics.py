"""What Spark's own counters tell of a query: rows that its joins wrote."""

from __future__ import annotations

import re


def joined_rows(spark, run) -> list[int]:
    """Rows out of each join that run() carried out, largest first."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    out = []
    for e in range(before, store.executionsCount()):
        values = store.executionMetrics(e)
        nodes = store.planGraph(e).allNodes()
        for i in range(nodes.size()):
            node = nodes.apply(i)
            if not re.search("Join|Cartesian", node.name()):
                continue
            for j in range(node.metrics().size()):
                m = node.metrics().apply(j)
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    out.append(int(re.sub("[^0-9]", "", values.apply(m.accumulatorId()).split("\n")[-1].split("(")[0]) or 0))
    return sorted(out, reverse=True)
