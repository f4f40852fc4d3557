"""Windows, orders, batches and states. Shard numbers, sizes and seeds of the cases are fixed values (FIXTURES.md)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom import (
    EpochOrder, LoaderState, batch_ordinals, batches, batches_in_order, epoch_plan, export_batches, loader_state, resume_from, step_plan,
    token_windows, total_plan,
)
from shardloom.functions.shuffle import permuted, permuted_column, round_keys, round_keys_column
from shardloom.operators.windows import undersized_shards
from shardloom.plans.epochs import ordered_shards
from shardloom.plans.state import check_state, missing_of_state, require_batches, resume_order
from shardloom.plans.steps import counted_updates, eval_batches, step_cadence, update_steps


def drawn(rows):
    """Batches in order, each as (epoch, inputs, targets)."""
    found = {}
    for r in sorted(rows.collect(), key=lambda r: (r.ordinal, r.row)):
        epoch, inputs, targets = found.setdefault(r.ordinal, (r.epoch, [], []))
        inputs.append(r.inputs)
        targets.append(r.targets)
    assert list(found) == list(range(min(found, default=0), max(found, default=-1) + 1))
    return list(found.values())


def simulate(shards, split, size, length, seed, count):
    """An independent loader: walks the shards one by one and shuffles the list in place."""
    rng, names, out = np.random.default_rng(seed), sorted(shards), []
    epoch = 0
    while True:
        if split == "train":
            rng.shuffle(names)
        for place, name in enumerate(names):
            tokens, at = shards[name], 0
            while len(tokens) - at >= size * length + 1:
                window = tokens[at:at + size * length + 1]
                at += size * length
                cut = lambda w: [w[i * length:(i + 1) * length] for i in range(size)]
                out.append((epoch, cut(window[:-1]), cut(window[1:]), place, at))
                if len(out) == count:
                    return out
        epoch += 1


def test_shift_and_next_batch(shard_table):
    rows = token_windows(shard_table("train", {1: range(20)}), 2, 3).orderBy("batch_in_shard", "row").collect()
    assert [r.inputs for r in rows] == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9, 10, 11], [12, 13, 14], [15, 16, 17]]
    assert [r.targets for r in rows] == [[t + 1 for t in r.inputs] for r in rows]


@pytest.mark.parametrize("tokens, count", [(0, 0), (5, 0), (6, 0), (7, 1), (12, 1), (13, 2)])
def test_windows_at_the_edges(shard_table, tokens, count):
    rows = token_windows(shard_table("train", {0: range(tokens)}), 2, 3)
    assert rows.count() == 2 * count


def test_undersized_shards(spark, shard_table):
    shards = shard_table("train", {0: range(6), 1: range(7)})
    assert [r.shard_index for r in undersized_shards(shards, 2, 3).collect()] == [0]
    with pytest.raises(ValueError, match="No shard contains enough tokens"):
        require_batches(shards, "train", 4, 3)
    with pytest.raises(ValueError, match="No shards found"):
        require_batches(shards, "val", 1, 1)
    with pytest.raises(ValueError, match="at least 1"):
        token_windows(shards, 0, 3)


def test_export_widens_ids(shard_table):
    rows = export_batches(token_windows(shard_table("val", {0: range(5)}), 1, 4))
    assert dict(rows.dtypes)["inputs"] == dict(rows.dtypes)["targets"] == "array<bigint>"


def test_validation_order_is_sorted_and_wraps(shard_table):
    shards = shard_table("val", {2: range(20, 30), 0: range(10), 1: range(10, 20)})
    order = epoch_plan(shards, 1, 4, seed=123, epochs=2).orderBy("epoch", "position").collect()
    assert [(r.epoch, r.shard_index) for r in order] == [(e, i) for e in (0, 1) for i in (0, 1, 2)]
    assert [r.first_ordinal for r in order] == [0, 2, 4, 6, 8, 10]

    wrap = shard_table("val", {0: range(5), 1: range(100, 105)})
    got = drawn(batches(wrap, epoch_plan(wrap, 1, 4, epochs=2), 1, 4, end=3))
    assert [(e, i[0]) for e, i, _ in got] == [(0, [0, 1, 2, 3]), (0, [100, 101, 102, 103]), (1, [0, 1, 2, 3])]
    after = loader_state(wrap, "val", 1, 4, drawn=3)
    assert (after.epoch, after.current_shard, after.token_position) == (1, 0, 4)


def test_numpy_mode_replays_compounding_shuffles(shard_table):
    shards = shard_table("train", {i: range(i * 10, i * 10 + 5) for i in range(1, 5)})
    rows = epoch_plan(shards, 1, 4, seed=17, epochs=2, mode="numpy").orderBy("epoch", "position").collect()
    assert [r.shard_index for r in rows] == [1, 3, 2, 4, 3, 1, 4, 2]
    later = epoch_plan(shards, 1, 4, seed=17, epochs=1, first_epoch=1, mode="numpy").orderBy("position").collect()
    assert [(r.epoch, r.shard_index) for r in later] == [(1, i) for i in (3, 1, 4, 2)]
    with pytest.raises(ValueError, match="mode"):
        epoch_plan(shards, 1, 4, mode="other")


def test_numpy_mode_is_bounded(shard_table, monkeypatch):
    monkeypatch.setattr("shardloom.plans.epochs.NUMPY_LIMIT", 2)
    with pytest.raises(ValueError, match="at most 2 shards"):
        epoch_plan(shard_table("train", {i: range(9) for i in range(3)}), 1, 4, mode="numpy")
    with pytest.raises(ValueError, match="over all epochs"):
        epoch_plan(shard_table("train", {i: range(9) for i in range(2)}), 1, 4, epochs=2, mode="numpy")


def test_keyed_order_is_reproducible_and_differs_by_epoch_and_seed(shard_table):
    shards = shard_table("train", {i: range(i * 10, i * 10 + 10) for i in range(8)})

    def orders(seed, partitions):
        rows = epoch_plan(shards.repartition(partitions), 1, 4, seed=seed, epochs=3).orderBy("epoch", "position").collect()
        assert [r.position for r in rows] == list(range(8)) * 3
        return tuple(tuple(r.shard_index for r in rows if r.epoch == e) for e in range(3))

    first = orders(123, 1)
    assert first == orders(123, 5)
    assert len(set(first)) == 3 and first != orders(124, 1)
    assert all(sorted(order) == list(range(8)) for order in first)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 4097])
def test_permutation_and_its_inverse(spark, n):
    keys = round_keys(10, 3)
    places = permuted(np.arange(n), n, keys)
    assert sorted(places) == list(range(n)) and (permuted(places, n, keys, inverse=True) == np.arange(n)).all()
    made = spark.range(min(n, 300)).withColumn("k", round_keys_column(10, F.lit(3))).select(
        "id", permuted_column(F.col("id"), F.lit(n), F.col("k")).alias("p"), permuted_column(F.col("id"), F.lit(n), F.col("k"), inverse=True).alias("q")
    )
    back = permuted(np.arange(n), n, keys, inverse=True)
    assert all((r.p, r.q) == (places[r.id], back[r.id]) for r in made.collect())


def test_permutations_are_even():
    seen = np.zeros((5, 5))
    orders = {}
    for epoch in range(2000):
        order = permuted(np.arange(5), 5, round_keys(1, epoch))
        seen[np.arange(5), order] += 1
        orders[tuple(order[:3])] = orders.get(tuple(order[:3]), 0) + 1
    assert ((seen - 400) ** 2 / 400).sum() < 45 and len(orders) == 60 and max(orders.values()) < 65


def test_order_of_a_billion_shards_is_an_expression(spark):
    order = EpochOrder("train", 10**9, 1_000_000, 10**15 - 7, 4, 128, seed=9)
    shards = spark.createDataFrame([("train", i, 1) for i in (0, 12_345, 10**9 - 1)], "split string, shard_index int, token_count int")
    rows = {r.shard_index: r for r in ordered_shards(shards, order, range(5, 6)).collect()}
    for index, r in rows.items():
        place = int(order.place(index, 5))
        assert (r.position, r.first_ordinal) == (place, order.first_ordinal(place, 5)) and int(order.shard_at(place, 5)) == index
        assert order.locate(r.first_ordinal) == (5, place, 0) and order.locate(r.first_ordinal - 1)[1] == place - 1
    assert next(order.segments(rows[0].first_ordinal + 3, rows[0].first_ordinal + 9)) == (0, 5, rows[0].first_ordinal + 3, 3, 6)


@pytest.mark.parametrize("tokens", [40, 41, 44, 45, 49, 50])
def test_closed_form_equals_the_general_plan(spark, shard_table, tokens):
    lists = {i: range(i * 10, min(i * 10 + 10, tokens)) for i in range(-(-tokens // 10))}
    shards = shard_table("train", lists).unionAll(shard_table("val", {0: range(10), 1: range(10), 2: range(6)}))
    totals = spark.createDataFrame([("train", tokens), ("val", 26), ("none", 0)], "split string, tokens bigint")
    plan = sorted(epoch_plan(shards, 1, 4, seed=5, epochs=3, first_epoch=2).collect())
    assert plan == sorted(total_plan(totals, 10, 1, 4, seed=5, epochs=3, first_epoch=2).collect())
    order = EpochOrder.of_totals(totals, "train", 10, 1, 4, seed=5)
    for first, end in ((0, None), (0, 3 * order.per_epoch), (order.per_epoch - 1, order.per_epoch + 3)):
        whole = batches(shards.filter("split = 'train'"), epoch_plan(shards.filter("split = 'train'"), 1, 4, seed=5, epochs=3), 1, 4, first, end or order.per_epoch)
        assert drawn(batches_in_order(shards, order, first, end)) == drawn(whole)
    pieces = [p for at in range(0, 3 * order.per_epoch, 3) for p in order.segments(at, min(at + 3, 3 * order.per_epoch))]
    listed = {r.ordinal: (r.shard_index, r.epoch, r.batch_in_shard) for r in batch_ordinals(epoch_plan(shards.filter("split = 'train'"), 1, 4, seed=5, epochs=3), 1, 4).collect()}
    assert {o + i: (s, e, b + i) for s, e, o, b, n in pieces for i in range(n)} == listed


def test_narrow_batches_move_no_token(spark, shard_table):
    order = EpochOrder("train", 3, 10, 30, 1, 4)
    plan = batches_in_order(shard_table("train", {i: range(10) for i in range(3)}), order)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_uneven_or_empty_sets_have_no_closed_form(spark):
    for shards, size, tokens in ((3, 10, 31), (3, 10, 20)):
        with pytest.raises(ValueError, match="not of one size"):
            EpochOrder("train", shards, size, tokens, 1, 4)
    with pytest.raises(ValueError, match="No shards found"):
        EpochOrder("train", 0, 10, 0, 1, 4)
    with pytest.raises(ValueError, match="No shard contains enough tokens"):
        EpochOrder("train", 1, 10, 4, 1, 4)


@pytest.mark.parametrize("split", ["train", "val"])
def test_batches_equal_a_sequential_loader(shard_table, split):
    lists = {1: range(100, 109), 2: range(200, 203), 3: range(300, 317), 4: range(400, 405)}
    shards = shard_table(split, lists)
    names = {f"dataset_{split}_{i:06d}.bin": list(t) for i, t in lists.items()}
    expected = simulate(names, split, 1, 4, 11, 20)
    plan = epoch_plan(shards, 1, 4, seed=11, epochs=4, mode="numpy")
    got = drawn(batches(shards, plan, 1, 4, end=20))
    assert [(e, i, t) for e, i, t, *_ in expected] == got
    with pytest.raises(ValueError, match="plan more epochs"):
        batches(shards, plan, 1, 4, end=10_000)
    ordinals = batch_ordinals(plan, 1, 4).filter("ordinal < 20").orderBy("ordinal").collect()
    assert [r.token_position + 4 for r in ordinals] == [at for *_, at in expected]


@pytest.mark.parametrize("first", [0, 1])
@pytest.mark.parametrize("n", [0, 1, 5, 8, 9])
def test_resume_equals_the_tail_of_the_whole_run(spark, shard_table, first, n):
    """Sets numbered from 0 have a closed form, others do not."""
    shards = shard_table("train", {i + first: range(i * 100, i * 100 + 9) for i in range(4)})
    whole = drawn(batches(shards, epoch_plan(shards, 1, 4, seed=11, epochs=4), 1, 4))
    state = LoaderState.from_json(loader_state(shards, "train", 1, 4, n, seed=11).to_json())
    plan, following = resume_from(shards, state, "train", 1, 4, epochs=4 - state.epoch)
    assert following == n
    assert drawn(batches(shards, plan, 1, 4, first=following)) == whole[n:]
    order, following = resume_order(shards, state, "train", 1, 4)
    assert (order is None) == (first == 1) and following == n
    if order:
        assert drawn(batches_in_order(shards, order, following, 4 * order.per_epoch)) == whole[n:]


def test_states_are_checked(spark, shard_table):
    from dataclasses import replace

    shards = shard_table("train", {1: range(20), 2: range(20)})
    state = loader_state(shards, "train", 1, 4, 3)
    with pytest.raises(ValueError, match="mismatch"):
        resume_from(shards, state, "train", 2, 4)
    with pytest.raises(ValueError, match="without any shards"):
        resume_from(shards, replace(state, shards=replace(state.shards, counts=(0, 0, 0))), "train", 1, 4)
    with pytest.raises(FileNotFoundError, match="dataset_train_000002"):
        resume_from(shards.filter("shard_index = 1"), state, "train", 1, 4)
    for other in ({1: range(20), 2: range(21)}, {1: range(20), 2: range(20), 3: range(20)}, {0: range(9), 1: range(20), 2: range(20)}):
        with pytest.raises(ValueError, match="differ"):
            resume_from(shard_table("train", other), state, "train", 1, 4)
    for broken, message in (
        ({"current_shard": 2}, "shard index"), ({"current_shard": -1}, "shard index"),
        ({"token_position": -4}, "token position"), ({"token_position": 3}, "token position"),
        ({"token_position": 24}, "token position"),
    ):
        with pytest.raises(ValueError, match=message):
            resume_from(shards, replace(state, **broken), "train", 1, 4)
    with pytest.raises(ValueError, match="split must be"):
        loader_state(shards, "test", 1, 4, 0)


def test_a_state_knows_which_of_many_shards_are_gone(spark):
    rows = spark.range(100_000).selectExpr("'train' AS split", "CAST(id AS INT) AS shard_index", "100 AS token_count")
    state = LoaderState.from_json(loader_state(rows, "train", 1, 4, 12_345).to_json())
    assert len(state.to_json()) < 16_000 and state.shards.shards == 100_000
    check_state(rows, state, "train", 1, 4)
    gone = {0, 5, 777, 50_000, 99_999}
    left = rows.filter(~F.col("shard_index").isin(*gone))
    assert {r.shard_name for r in missing_of_state(left, state).collect()} == {f"dataset_train_{i:06d}.bin" for i in gone}
    with pytest.raises(FileNotFoundError) as raised:
        check_state(left, state, "train", 1, 4)
    assert str(raised.value).count("there)") == 4  # 0 and 5 share a range
    resized = rows.withColumn("token_count", F.when(F.col("shard_index") == 50_000, 99).otherwise(100))
    with pytest.raises(ValueError, match="differ.*dataset_train_04"):
        check_state(resized, state, "train", 1, 4)


def test_steps_group_batches_and_mark_what_is_due(spark):
    ordinals = spark.range(40).withColumnRenamed("id", "ordinal")
    rows = step_plan(ordinals, 4, 2, 8, total_steps=7).orderBy("ordinal").collect()
    assert [(r.update_step, r.micro_step, r.tokens) for r in rows] == [(o // 4 + 1, o % 4, (o // 4 + 1) * 64) for o in range(28)]
    due = step_cadence(spark.range(1, 8).toDF("update_step"), 2, 3, 5, 7).orderBy("update_step").collect()
    assert [r.update_step for r in due if r.log_due] == [2, 4, 6]
    assert [r.update_step for r in due if r.eval_due] == [3, 6]
    assert [r.update_step for r in due if r.checkpoint_due] == [5, 7]
    with pytest.raises(ValueError, match="accumulation_steps"):
        step_plan(ordinals, 0, 1, 1)


@pytest.mark.parametrize("count, total", [(10, None), (8, 7), (29, 7), (1, 7)])
def test_updates_follow_from_the_number_of_batches(spark, count, total):
    planned = step_plan(spark.range(count).withColumnRenamed("id", "ordinal"), 4, 2, 8, total_steps=total)
    schedule = {"warmup_steps": 2, "total_steps": total or 9}
    listed = sorted(update_steps(planned, **schedule).collect())
    assert sorted(counted_updates(spark, count, 4, 2, 8, total, **schedule).collect()) == listed


def test_eval_batches_are_the_first_of_validation_over_epochs(spark, shard_table):
    shards = shard_table("val", {0: range(10), 1: range(10, 16)}).unionAll(shard_table("train", {0: range(50, 60)}))
    order = EpochOrder("val", 2, 10, 16, 1, 4)
    got = drawn(eval_batches(shards, order, 5))
    assert [(e, i[0][0]) for e, i, _ in got] == [(0, 0), (0, 4), (0, 10), (1, 0), (1, 4)]
    with pytest.raises(ValueError, match="eval_steps"):
        eval_batches(shards, order, 0)
    with pytest.raises(ValueError, match="val split"):
        eval_batches(shards, EpochOrder("train", 1, 10, 10, 1, 4), 1)
