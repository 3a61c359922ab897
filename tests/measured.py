"""What Spark's own metrics say of a run."""


def metrics(spark, run, node: str, metric: str) -> list[int]:
    """The values of a metric of all nodes of that name (any: empty), of every plan that run() executes."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    before = store.executionsCount()
    run()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    out, made = [], store.executionsList(int(before), 1_000_000)
    for k in range(made.size()):
        found = made.apply(k).executionId()
        values, nodes = store.executionMetrics(found), store.planGraph(found).allNodes()
        for i in range(nodes.size()):
            n = nodes.apply(i)
            of = n.metrics()
            for j in range(of.size()):
                told = values.get(of.apply(j).accumulatorId())
                if node in n.name() and of.apply(j).name() == metric and told.isDefined():
                    out.append(told.get())
    return [_number(v) for v in out]


def _number(told: str) -> int:
    """The total of a told metric; sizes in bytes."""
    first = told.split("\n")[-1].split(" (")[0].replace(",", "").split()
    return int(float(first[0]) * {"B": 1, "KiB": 2**10, "MiB": 2**20, "GiB": 2**30}.get(first[1] if len(first) > 1 else "B", 1))


def most_rows(spark, run) -> int:
    return max(metrics(spark, run, "", "number of output rows"), default=0)
