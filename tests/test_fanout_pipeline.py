import pytest

from braidframe import pipeline
from braidframe.operators import fanout


def test_zip_and_product():
    assert fanout.zip_rows(a=[1, 2], b="xy".split("|") * 2) == [{"a": 1, "b": "xy"}, {"a": 2, "b": "xy"}]
    assert [(r["a"], r["b"]) for r in fanout.product_rows(a=[1, 2], b=[3, 4])] == [(1, 3), (1, 4), (2, 3), (2, 4)]
    with pytest.raises(ValueError, match="different length"):
        fanout.zip_rows(a=[1], b=[1, 2])
    with pytest.raises(TypeError, match="characters"):
        fanout.zip_rows(a="text")
    with pytest.raises(ValueError, match="expand"):
        fanout.product_rows(a=fanout.expand("{x}", x=[1, 2]))


def test_per_branch():
    rows = fanout.product_rows(s=["a", "b"], path=fanout.per_branch("out/{s}.csv"))
    assert [r["path"] for r in rows] == ["out/a.csv", "out/b.csv"]
    with pytest.raises(ValueError, match="unknown"):
        fanout.zip_rows(s=[1], p=fanout.per_branch("{q}"))
    with pytest.raises(ValueError, match="at least one"):
        fanout.zip_rows(p=fanout.per_branch("{x}"))
    with pytest.raises(ValueError, match="no placeholders"):
        fanout.per_branch("x")


def test_expand():
    assert fanout.expand("{b}-{a}", a=[1, 2], b=["x", "y"]) == ["x-1", "x-2", "y-1", "y-2"]
    assert fanout.zip_expand("{a}/{b}", a=[1, 2], b="z z".split()) == ["1/z", "2/z"]
    for bad in (lambda: fanout.expand("{a}"), lambda: fanout.expand("{a}", a="text"), lambda: fanout.zip_expand("{a}", a="text"), lambda: fanout.expand("x", a=1), lambda: fanout.expand("{}", a=1), lambda: fanout.zip_expand("{a}{b}", a=[1], b=[1, 2])):
        with pytest.raises(ValueError):
            bad()
    assert fanout.flatten([1, (2, [3, "ab"]), []]) == [1, 2, 3, "ab"]


def test_branch_tables(spark):
    a, b = fanout.branches(spark, fanout.zip_rows(x=[1, 2])), fanout.branches(spark, fanout.zip_rows(y=[7, 8, 9]))
    assert sorted((r["branch"], r["x"], r["y"]) for r in fanout.chain(a, b).collect()) == [(i, 1 + i // 3, 7 + i % 3) for i in range(6)]
    with pytest.raises(ValueError):
        fanout.branches(spark, [])
    assert fanout.branches(spark, [], "x int").count() == 0
    u = fanout.union_branches([spark.range(1), spark.range(2)])
    assert sorted(r["branch"] for r in u.collect()) == [0, 1, 1]


def registry():
    r = pipeline.Registry()
    calls = []

    @r.step()
    def add(a, b=1):
        calls.append((a, b))
        return a + b

    @r.step(retries=2, backoff=1.0)
    def flaky(n):
        calls.append(n)
        if len(calls) < 3:
            raise RuntimeError("again")
        return n

    return r, add, flaky, calls


def test_calls_and_evaluation():
    _, add, _, calls = registry()
    one = add(a=1)
    total = add(a=one, b=add(a=one))
    assert pipeline.evaluate({"k": [total, (one,)]}) == {"k": [5, (2,)]}
    assert calls.count((1, 1)) == 1
    for bad in (lambda: iter(one), lambda: len(one), lambda: one[0]):
        with pytest.raises(TypeError):
            bad()
    with pytest.raises(TypeError, match="unknown"):
        add(c=1)


def test_partial_fan_out_and_gather():
    _, add, _, _ = registry()
    branches = add(b=10).map(a=[1, 2]).map(b=[0, 5])
    assert pipeline.evaluate(branches) == [1, 6, 2, 7]
    assert pipeline.display_labels(list(branches))[0].startswith("registry")
    assert pipeline.evaluate(add(b=1).product_map(a=[1, 2])) == [2, 3]


def test_dynamic_expansion_and_none():
    r = pipeline.Registry()

    @r.step()
    def leaf(i):
        return None if i == 1 else i

    @r.step()
    def plan(n):
        return leaf().map(i=list(range(n)))

    assert pipeline.evaluate(plan(n=3)) == [0, None, 2]


def test_retries_wait_and_give_up():
    _, _, flaky, _ = registry()
    waits, events = [], []
    assert pipeline.evaluate(flaky(n=4), sleep=waits.append, on_event=lambda e, c, n: events.append((e, n))) == 4
    assert waits == [1.0, 2.0] and events[-1] == ("succeeded", 3)
    r = pipeline.Registry()

    @r.step(retries=1, retry_on=(KeyError,))
    def broken():
        raise ValueError("no")

    with pytest.raises(ValueError):
        pipeline.evaluate(broken(), sleep=lambda _: None)


def test_graph_dead_and_cycle():
    _, add, _, _ = registry()
    a = add(a=1)
    b, lost = add(a=a), add(a=5)
    order, edges = pipeline.graph(b)
    assert order == [a, b] and edges == [(1, 0)]
    assert pipeline.dead([a, b, lost], b) == [lost]
    args = {}
    loop = pipeline.Call(add.__class__(add.function, "loop"), args)
    args["a"] = loop
    with pytest.raises(pipeline.CycleError):
        pipeline.graph(loop)


def test_flow_and_admission():
    r, *_ = registry()
    with pytest.raises(LookupError):
        r.the_flow()
    flow = r.flow(lambda: 1)
    assert r.the_flow() is flow
    assert pipeline.admit({"s": {"memory": 5, "gpu": 1}}, {"memory": 4}) == ["s: memory 5 exceeds 4", "s: no budget for gpu"]


def test_parts():
    r = pipeline.Registry()

    @r.step()
    def pair(x):
        return x, x * 2

    assert pipeline.evaluate(pair(x=3).output[1]) == 6
    assert pipeline.evaluate(pair().map(x=[1, 2]).output[1]) == [2, 4]


def test_optional_outputs(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    outputs = {"a": str(tmp_path / "a"), "b": pipeline.optional(str(tmp_path / "b")), "c": pipeline.optional(str(tmp_path / "a"))}
    assert pipeline.present_outputs(spark, outputs) == {"a": str(tmp_path / "a"), "b": None, "c": str(tmp_path / "a")}
    with pytest.raises(FileNotFoundError, match="did not create"):
        pipeline.present_outputs(spark, {"b": str(tmp_path / "b")})
    for bad in (pipeline.optional("x"), 3):
        with pytest.raises(TypeError):
            pipeline.optional(bad)


def test_what_fits():
    make = pipeline.Ready
    ready = [make("a", 2, 4), make("b", 3, priority=1), make("c", 1, 9), make("d", 1, group="g"), make("e", 1, group="g"), make("f", 1, custom={"lic": 2}), make("g", 0, gpus=1)]
    assert pipeline.select_feasible(ready, jobs=9, cores=6, memory_gb=8, group_slots={"g": 1}, budgets={"lic": 1}) == ["b", "a", "d"]
    assert pipeline.select_feasible(ready, jobs=1, cores=9) == ["b"] and pipeline.select_feasible(ready, jobs=0, cores=9) == []
    assert pipeline.select_feasible(ready, jobs=9, cores=0, gpus=1) == ["g"]
    assert pipeline.select_feasible([], jobs=3, cores=1) == []
    assert pipeline.place(make("a", 2), {"cores": 4}, False) == "local" and pipeline.place(make("a", 8), {"cores": 4}, True) == "remote"
    with pytest.raises(ValueError, match="cores"):
        pipeline.place(make("a", 8), {"cores": 4}, False)


def test_validation_before_running():
    r, add, _, _ = registry()
    a = add(a=1)
    b, lost = add(a=a), add(a=5)
    assert pipeline.validate(r, b) == [] and "not used" in pipeline.validate(r, b, constructed=[a, b, lost])[0]
    other = pipeline.Registry()
    assert "not a registered step" in pipeline.validate(other, b)[0]

    @r.step(threads=4, memory_gb=2, custom={"lic": 1}, priority=3)
    def big():
        return 1

    assert pipeline.validate(r, big(), {"threads": 2, "memory_gb": 8}) == ["%s: threads 4 exceeds 2" % big.name, "%s: no budget for lic" % big.name]
    assert big.ready(group="g") == pipeline.Ready(big.name, 4, 2, 0, "g", 3, {"lic": 1})
    args = {}
    loop = pipeline.Call(add, args)
    args["a"] = loop
    assert "itself" in pipeline.validate(r, loop)[0]


def test_retries_by_exit_code():
    class Failed(RuntimeError):
        def __init__(self, code):
            self.exit_code = code

    codes = [137, 137, 1]
    r = pipeline.Registry()

    @r.step(retries=5, retry_on=(RuntimeError,), retry_on_codes=frozenset({137}))
    def run():
        raise Failed(codes.pop(0))

    with pytest.raises(Failed) as e:
        pipeline.evaluate(run(), sleep=lambda _: None)
    assert e.value.exit_code == 1 and codes == []


def test_concurrency_of_branches():
    _, add, _, _ = registry()
    calls = add(b=1).map(a=[1, 2, 3], max_concurrent=2).map(b=[4, 5])
    (group,) = calls.slots
    assert calls.slots[group] == 2 and {c.group for c in calls} == {group} and len(calls) == 6
    ready = [c.step.ready(c.label, c.group) for c in calls]
    assert len(pipeline.select_feasible(ready, jobs=9, cores=9, group_slots=calls.slots)) == 2
    assert pipeline.evaluate(calls) == [5, 6, 6, 7, 7, 8] and add(b=1).map(a=[1]).slots == {}
    with pytest.raises(ValueError):
        add(b=1).map(a=[1], max_concurrent=0)
