"""Rules around experiments: names, seeds, schedules, what may be compared and reused."""

from __future__ import annotations

import hashlib
import math
import random
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def set_mode(one: str, two: str | None) -> str:
    """How two input folders relate: symmetric (one, or the same twice), bipartite, or an error where one is in the other."""
    if two is None or one.rstrip("/") == two.rstrip("/"):
        return "symmetric"
    a, b = one.rstrip("/") + "/", two.rstrip("/") + "/"
    if a.startswith(b) or b.startswith(a):
        raise ValueError("one folder is inside the other")
    return "bipartite"


def parse_source(text: str) -> tuple[str, str]:
    """NAME=PATH, or PATH, whose last part then names it; names are of letters, digits, dots, dashes, underscores."""
    name, _, path = text.partition("=") if "=" in text else (text.rstrip("/").rsplit("/", 1)[-1], "", text)
    name = re.sub("[^A-Za-z0-9._-]+", "_", name).strip("_")
    if not name or not path:
        raise ValueError(f"not a source: {text}")
    return name, path


def checkpoint_name(model: str, epoch: int, share: float) -> str:
    return f"{model}-e{epoch:03d}-s{f'{share:.12g}'.replace('.', 'p')}"


def parse_checkpoint(name: str) -> tuple[str, int, float]:
    m = re.fullmatch(r"(.+)-e(\d{3,})-s(\d+(?:p\d+)?)", name)
    if not m:
        raise ValueError(f"not a checkpoint: {name}")
    return m[1], int(m[2]), float(m[3].replace("p", "."))


def task_seed(*parts: str) -> int:
    """A 64-bit seed that depends on the names alone."""
    return int.from_bytes(hashlib.sha256("\0".join(parts).encode()).digest()[:8], "big")


def lineage_id(segments: list[str]) -> str:
    """A name-based UUID of the hashes of all segments."""
    return str(uuid.uuid5(uuid.NAMESPACE_URL, "/".join(hashlib.sha256(s.encode()).hexdigest() for s in segments)))


def log_grid(low: int, high: int, points: int) -> list[int]:
    """Distinct whole numbers from low to high, evenly spaced in logs, both ends in."""
    if not 0 < low < high or points < 2:
        raise ValueError("a grid needs 0 < low < high and two points")
    step = (math.log(high) - math.log(low)) / (points - 1)
    return sorted({low, high, *(round(math.exp(math.log(low) + k * step)) for k in range(points))})


def check_targets(targets: list[float], ks: list[int]) -> None:
    if any(not 0 < t <= 1 for t in targets) or sorted(set(targets)) != list(targets):
        raise ValueError("targets are distinct, rising, above 0 and at most 1")
    if any(k < 1 for k in ks) or len(set(ks)) != len(ks):
        raise ValueError("every k is distinct and positive")


def check_calibration(calibration: list[str], test: list[str]) -> None:
    """Calibration names its subsets and none of them is a test subset."""
    if not calibration or "*" in calibration or set(calibration) & set(test):
        raise ValueError("calibration may use neither test subsets nor wildcards")


def latin_square(items: DataFrame, n: int) -> DataFrame:
    """Of (slot) 0..n-1: a cyclic schedule, each item once in each place but always before the same other: block, place, item."""
    blocks = items.select("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"))
    return blocks.select(F.col("block").cast("long").alias("block"), F.col("slot").cast("long").alias("place"), ((F.col("slot") + F.col("block")) % n).cast("long").alias("item"))


def williams_rows(n: int) -> list[list[int]]:
    """Rows 0, n-1, 1, n-2, ... and its shifts, with their reversals where n is odd: each item equally often in each place,
    and each ordered pair of neighbours equally often."""
    if n < 1:
        raise ValueError("a schedule needs an item")
    first = [p // 2 if p % 2 == 0 else n - 1 - p // 2 for p in range(n)]
    rows = [[(x + shift) % n for x in first] for shift in range(n)] if n > 1 else [first]
    return rows + [row[::-1] for row in rows] if n > 1 and n % 2 else rows


def williams_schedule(spark: SparkSession, models: list[str], cycle_seeds: list[int], image_seed: int) -> DataFrame:
    """All Williams rows in each cycle, models and rows shuffled by its seed, every block with its own seed for the images:
    block, cycle, block_within_cycle, canonical_row, image_order_seed, place, model. Blocks and cycles start at 1."""
    if len(set(models)) != len(models) or len(set(cycle_seeds)) != len(cycle_seeds):
        raise ValueError("models and seeds are distinct")
    rows, images, out, block = williams_rows(len(models)), random.Random(image_seed), [], 0
    for cycle, seed in enumerate(cycle_seeds, 1):
        rng, mapped, order = random.Random(seed), list(models), list(range(len(rows)))
        rng.shuffle(mapped)
        rng.shuffle(order)
        for within, row in enumerate(order, 1):
            block, image = block + 1, images.randrange(0, 2**63)
            out += [(block, cycle, within, row, image, place, mapped[x]) for place, x in enumerate(rows[row])]
    return spark.createDataFrame(out, "block long, cycle long, block_within_cycle long, canonical_row long, image_order_seed long, place long, model string")


def neighbours(schedule: DataFrame) -> DataFrame:
    """How often a model comes right before another: cycle, before, model, n."""
    before = F.lag("model").over(Window.partitionBy("cycle", "block").orderBy("place"))
    return schedule.select("cycle", before.alias("before"), "model").where("before is not null").groupBy("cycle", "before", "model").agg(F.count(F.lit(1)).alias("n"))


def unbalanced(schedule: DataFrame) -> DataFrame:
    """Where a schedule isn't balanced, a row each: cycle, rule, what, n, expected. Blocks have every model once; a cycle has
    all its blocks, each model in each place and each ordered pair of neighbours equally often."""
    models = schedule.select("cycle", "model").distinct()
    size = models.groupBy("cycle").agg(F.count(F.lit(1)).alias("m"))
    size = size.withColumn("each", F.when((F.col("m") == 1) | (F.col("m") % 2 == 0), F.lit(1)).otherwise(2).cast("long"))
    row = lambda df, rule, what, n, expected: df.select("cycle", F.lit(rule).alias("rule"), what.alias("what"), n.alias("n"), expected.alias("expected")).where("n <> expected")
    blocks = schedule.groupBy("cycle", "block").agg(F.count(F.lit(1)).alias("k"), F.countDistinct("model").alias("d")).join(size, "cycle")
    # A row too many counts against its block even where all models are there.
    whole = row(blocks, "block", F.col("block").cast("string"), F.when(F.col("k") == F.col("m"), F.col("d")).otherwise(F.col("k")), F.col("m"))
    number = row(schedule.groupBy("cycle").agg(F.countDistinct("block").alias("k")).join(size, "cycle"), "blocks", F.lit(""), F.col("k"), F.col("m") * F.col("each"))
    grid = models.join(size, "cycle").withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    placed = grid.join(schedule.groupBy("cycle", "model", "place").agg(F.count(F.lit(1)).alias("k")), ["cycle", "model", "place"], "left")
    places = row(placed, "place", F.concat_ws(" ", "model", "place"), F.coalesce("k", F.lit(0)), F.col("each"))
    ordered = models.join(size, "cycle").join(models.withColumnRenamed("model", "before"), "cycle").where("before <> model")
    met = ordered.join(neighbours(schedule).withColumnRenamed("n", "k"), ["cycle", "before", "model"], "left")
    return whole.unionByName(number).unionByName(places).unionByName(row(met, "neighbours", F.concat_ws(" ", "before", "model"), F.coalesce("k", F.lit(0)), F.col("each")))


def queue_changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that only one of two queues has; once decisions exist a queue must stay as it is."""
    gone, added = old.exceptAll(new), new.exceptAll(old)
    return gone.withColumn("change", F.lit("gone")).unionByName(added.withColumn("change", F.lit("added")))


def complete_protocols(rows: DataFrame, group: str, key: str, expected: list) -> DataFrame:
    """Rows of the groups that have every expected key and no other."""
    want = F.array_sort(F.array(*[F.lit(e) for e in expected]))
    whole = rows.groupBy(group).agg(F.array_sort(F.collect_set(key)).alias("_has")).where(F.col("_has") == want).select(group)
    return rows.join(whole, group, "left_semi")


def severity(transforms: Column) -> tuple[Column, Column]:
    """Of the JSON of an image's transforms: how strong they are, from 0 to 1, and the bucket: mild, medium, hard, extreme.

    What is missing counts as not done. The weights and cuts are fixed values.
    """
    number = lambda path, default: F.coalesce(F.get_json_object(transforms, f"$.{path}").cast("double"), F.lit(default))
    done = lambda path, weight: F.when(F.get_json_object(transforms, f"$.{path}.applied") == "true", weight).otherwise(0.0)
    score = F.greatest(F.lit(0.0), 1.0 - number("crop.retained_area_fraction", 1.0)) * 0.40
    score += F.greatest(F.lit(0.0), F.least(F.lit(1.0), (192 - F.floor(number("resolution_loss.longest_side_pixels", 1024.0))) / 160.0)) * 0.45
    score += done("perspective", 0.10) + F.least(F.lit(0.10), number("occlusion.coverage", 0.0)) + done("annotations", 0.05) + done("paper_document", 0.05)
    score += F.when(F.floor(number("jpeg.quality", 100.0)) <= 72, 0.08).otherwise(0.0)
    score = F.round(F.least(F.lit(1.0), score), 6)
    return score, F.when(score >= 0.72, "extreme").when(score >= 0.50, "hard").when(score >= 0.25, "medium").otherwise("mild")


#: Partners that greedy_boxes keeps of a box.
NEXT = 64


def greedy_boxes(boxes: DataFrame, least: float) -> DataFrame:
    """One-to-one matches of found to true boxes in each scene, by falling overlap: (scene, found, id, x0, y0, x1, y1) to
    scene, found_id, true_id, iou. Each choice rules out others, so a scene is matched in one task, but never with all its
    pairs: each box of the smaller side has its next NEXT partners, and looks for more when these are taken."""
    import heapq

    import numpy as np
    import pandas as pd

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [pdf[pdf["found"] == k] for k in (True, False)]
        owner = 0 if len(sides[0]) < len(sides[1]) else 1  # 0: found boxes choose, 1: true ones
        ids, other_ids = (sides[k]["id"].to_numpy() for k in (owner, 1 - owner))
        mine, other = (sides[k][["x0", "y0", "x1", "y1"]].to_numpy(float).T for k in (owner, 1 - owner))
        size, other_size = ((b[2] - b[0]) * (b[3] - b[1]) for b in (mine, other))
        free, used, out = np.ones(len(other_ids), bool), set(), []
        _, person = np.unique(other_ids, return_inverse=True)  # rows of one id are taken together
        rows_of = np.split(np.argsort(person, kind="stable"), np.cumsum(np.bincount(person))[:-1]) if len(other_ids) else []

        def partners(k: int) -> tuple:
            """The next partners of box k among the free ones, the best one first, with their overlaps."""
            w = np.minimum(mine[2][k], other[2]) - np.maximum(mine[0][k], other[0])
            h = np.minimum(mine[3][k], other[3]) - np.maximum(mine[1][k], other[1])
            inter = np.maximum(0.0, w) * np.maximum(0.0, h)
            union = (size[k] + other_size if owner == 0 else other_size + size[k]) - inter
            iou = np.divide(inter, union, out=np.full(len(union), -1.0), where=(union > 0) & free)
            at = np.flatnonzero((iou >= least) & (union > 0) & free)
            if len(at) > NEXT:
                last = np.partition(iou[at], -NEXT)[-NEXT]
                above, tied = at[iou[at] > last], at[iou[at] == last]
                tied = tied[np.argsort(other_ids[tied], kind="stable")][: NEXT - len(above)]
                at = np.concatenate([above, tied])
            at = at[np.lexsort((other_ids[at], -iou[at]))]
            return at.astype(np.int32), iou[at]

        held, heap = {}, []

        def push(k: int) -> None:
            left = np.flatnonzero(free[held[k][0]]) if k in held else ()
            if not len(left):
                held[k], left = partners(k), (0,)
            if len(held[k][0]):
                x = int(held[k][0][left[0]])
                pair = (int(ids[k]), int(other_ids[x]))
                heapq.heappush(heap, (-float(held[k][1][left[0]]), *(pair if owner == 0 else pair[::-1]), k, x))

        for k in range(len(ids)):
            push(k)
        while heap:
            iou, f, t, k, x = heapq.heappop(heap)
            if ids[k] in used:
                continue
            if not free[x]:
                push(k)
                continue
            used.add(ids[k])
            free[rows_of[person[x]]] = False
            del held[k]
            out.append((pdf["scene"].iloc[0], f, t, round(-iou, 6)))
        return pd.DataFrame(out, columns=["scene", "found_id", "true_id", "iou"])

    return boxes.groupBy("scene").applyInPandas(match, "scene long, found_id long, true_id long, iou double")
