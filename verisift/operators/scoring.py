"""A scoring model over tables of sources: packed passages, a time budget for each request, and rankers that only permute.

The model is any object that load() makes, once for each task, with score(pairs) giving a number in [0, 1] for each pair of
question and passage. Sources of a request reserve their estimated cost one after another and give back what they did not
use; the sources that are next in their requests are scored together, in packs of passages of all these requests.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisift.operators.requests import MS_PER_CANDIDATE

#: Passages of a source that a model is given, and characters of each.
MOST_PASSAGES, PASSAGE_CHARS = 32, 2000
#: Passages of a pack.
PACK = 64


def _scored_packs(model, clock: Callable[[], float], wanted: list[tuple[int, str, list[str]]]) -> dict[int, tuple[list[float] | None, float]]:
    """Scores and milliseconds of each source (number, question, passages). A pack that fails leaves its sources without
    scores; its time counts all the same, in equal parts for its passages."""
    pairs = [(len(p), i, j, q, p[:PASSAGE_CHARS]) for i, q, ps in wanted for j, p in enumerate(ps[:MOST_PASSAGES])]
    pairs.sort(key=lambda x: x[:3])  # passages of like length together
    found = {i: [None] * len(ps) for i, _, ps in wanted}
    spent = {i: 0.0 for i, _, _ in wanted}
    for at in range(0, len(pairs), PACK):
        pack, began = pairs[at : at + PACK], clock()
        try:
            made = list(model.score([(q, p) for _, _, _, q, p in pack]))
        except Exception:  # a model that fails must not fail the request
            made = []
        each = (clock() - began) * 1000 / len(pack)
        for k, (_, i, j, _, _) in enumerate(pack):
            spent[i] += each
            if len(made) == len(pack):
                found[i][j] = made[k]
    usable = lambda s: all(isinstance(x, int | float) and math.isfinite(x) and 0 <= x <= 1 for x in s)
    return {i: ([float(x) for x in s] if usable(s) else None, spent[i]) for i, s in found.items()}


def score_sources(sources: DataFrame, load: Callable[[], object], budget_ms: int, *keys: str, pos: str = "pos", question: str = "question", passages: str = "passages") -> DataFrame:
    """keys, pos, n_passages, called, scores, spent_ms and left_ms (of the request, afterwards) of every source.

    In the order of pos, a source with two passages or more is scored if the budget left covers MS_PER_CANDIDATE for each;
    what the call really took, by the model's clock() if it has one, is then taken off instead. `scores` is null if the
    source was not sent, the model failed, or a score is missing (as beyond MOST_PASSAGES) or no number in [0, 1]; then the
    order stays lexical. Null passages are none. A request's sources stream by; only the budget left is held, so that a
    request of any size is one long stream."""
    fields = {f.name: f.dataType.simpleString() for f in sources.schema}
    names = [*[f"k{i}" for i in range(len(keys))], "pos", "question", "passages"]
    rows = sources.select(*[F.col(c).alias(n) for c, n in zip([*keys, pos, question, passages], names, strict=True)])
    by = names[: len(keys)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        clock = getattr(model, "clock", time.perf_counter)
        request, left = None, 0.0
        for frame in frames:
            if not len(frame):
                continue
            owners = list(frame[by].itertuples(index=False, name=None))
            texts = [[] if p is None else ["" if x is None else x for x in p] for p in frame["passages"]]
            number, budgets, turn = [], [], []
            for i, owner in enumerate(owners):
                if i == 0 or owner != owners[i - 1]:
                    budgets.append(left if i == 0 and owner == request else float(budget_ms))
                    turn.append(0)
                else:
                    turn.append(turn[-1] + 1)
                number.append(len(budgets) - 1)
            rounds: list[list[int]] = [[] for _ in range(max(turn) + 1)]
            for i, t in enumerate(turn):
                rounds[t].append(i)
            out = [(len(t), False, None, 0.0, 0.0) for t in texts]
            for members in rounds:
                sent = [i for i in members if len(texts[i]) >= 2 and len(texts[i]) * MS_PER_CANDIDATE <= budgets[number[i]]]
                made = _scored_packs(model, clock, [(i, frame["question"].iloc[i], texts[i]) for i in sent])
                for i in members:
                    scores, spent = made.get(i, (None, 0.0))
                    budgets[number[i]] -= spent
                    out[i] = (len(texts[i]), i in made, scores, spent, budgets[number[i]])
            request, left = owners[-1], budgets[-1]
            values = pd.DataFrame(out, columns=["n_passages", "called", "scores", "spent_ms", "left_ms"])
            yield pd.concat([frame[[*by, "pos"]].reset_index(drop=True), values], axis=1)

    shape = ", ".join(f"{n} {fields[c]}" for n, c in zip([*by, "pos"], [*keys, pos], strict=True))
    made = rows.repartition(*by).sortWithinPartitions(*by, "pos").mapInPandas(run, f"{shape}, n_passages int, called boolean, scores array<double>, spent_ms double, left_ms double")
    return made.withColumnsRenamed(dict(zip([*by, "pos"], [*keys, pos], strict=True)))


# --- rankers --------------------------------------------------------------------------------------------------


def is_permutation(order: Column, n: Column) -> Column:
    """Whether an array holds the numbers from 0 to n - 1, each once; false for null."""
    return F.coalesce(F.array_sort(order).eqNullSafe(F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: i - 1)).otherwise(F.array().cast("array<int>"))), F.lit(False))


def apply_order(ranked: DataFrame, order: str, candidates: str = "candidates") -> DataFrame:
    """Candidates in the order that a ranker gives (places from 0, as an array), with `reordered`. An order that leaves out,
    repeats or adds a candidate, or none, changes nothing: a ranker never adds or removes evidence."""
    places, all_of = F.col(order).cast("array<int>"), F.col(candidates)
    good = is_permutation(places, F.size(all_of))
    return ranked.withColumns({candidates: F.when(good, F.transform(places, lambda i: F.get(all_of, i))).otherwise(all_of), "reordered": good})


def only_permuted(before: Column, after: Column) -> Column:
    """Whether two arrays hold the same elements as often: compared in sorted order, whatever a ranker may have done."""
    return F.coalesce(F.array_sort(before) == F.array_sort(after), F.lit(False))


def keep_if_permuted(ranked: DataFrame, before: str, after: str, into: str = "candidates") -> DataFrame:
    """`into`: what a ranker made of the candidates if it only reordered them, else the candidates as they were."""
    same = only_permuted(F.col(before), F.col(after))
    return ranked.withColumns({into: F.when(same, F.col(after)).otherwise(F.col(before)), "reordered": same})
