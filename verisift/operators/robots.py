"""robots.txt rules against many paths: the rules of an origin become one structure, probed once for each path."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ways that the paths of one origin are dealt out; its rules, bounded by the size of a robots.txt, go along each.
SALTS = 16


class Rules:
    """Rules by their plain prefix, up to the first `*` or the closing `$`. A path looks up its prefixes of the lengths that
    occur, however many rules there are; only what follows a `*` is looked for in the path itself."""

    def __init__(self):
        self.by_prefix: dict[str, list[tuple[int, bool, str, list[str] | None, bool]]] = {}
        self.lengths: list[int] = []

    def add(self, allow: bool, path: str) -> None:
        ends = path.endswith("$")
        first, *rest = (path[:-1] if ends else path).split("*")
        self.by_prefix.setdefault(first, []).append((len(path), allow, path, rest, ends))

    def close(self) -> None:
        self.lengths = sorted({len(p) for p in self.by_prefix})

    @staticmethod
    def _rest_matches(path: str, at: int, rest: list[str], ends: bool) -> bool:
        """Whether the pieces between stars follow one another from `at` on; the last one ends the path if it must."""
        if not rest:
            return at == len(path) or not ends
        for piece in rest[:-1]:
            found = path.find(piece, at)
            if found < 0:
                return False
            at = found + len(piece)
        return len(path) - at >= len(rest[-1]) and path.endswith(rest[-1]) if ends else path.find(rest[-1], at) >= 0

    def decide(self, path: str) -> tuple[bool, str | None]:
        """Whether a path may be read, and the deciding rule: the longest that matches, allow before disallow; none: true."""
        best = (-1, True, None)
        for n in self.lengths:
            if n > len(path):
                break
            for size, allow, rule, rest, ends in self.by_prefix.get(path[:n], ()):
                if (size, allow) > best[:2] and self._rest_matches(path, n, rest, ends):
                    best = (size, allow, rule)
        return best[1], best[2]


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by owner (an origin and a salt), rules before paths, to verdicts. One owner's rules are held at a time."""
    owner, rules, open_ = object(), Rules(), True
    for batch in batches:
        kept, allowed, deciding = [], [], []
        for i, (whose, is_path, path, allow) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("owner", "is_path", "path", "allow")), strict=True)):
            if whose != owner:
                owner, rules, open_ = whose, Rules(), True
            if not is_path:
                rules.add(allow, path)
                continue
            if open_:
                rules.close()
                open_ = False
            may, rule = rules.decide(path) if path is not None and whose is not None else (True, None)
            kept.append(i)
            allowed.append(may)
            deciding.append(rule)
        if kept:
            at = pa.array(kept)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("path").take(at), pa.array(allowed, pa.bool_()), pa.array(deciding, pa.string())], names=["id", "path", "allowed", "rule"])


def verdicts(urls: DataFrame, rules: DataFrame, salts: int = SALTS) -> DataFrame:
    """id, path, allowed and the deciding rule (null: none) of every row (id, origin, path) of urls.

    rules (origin, allow, path): `*` matches anything, a closing `$` ends the path, the longest rule that matches decides and
    allow wins ties; an empty rule is none. Null origins and paths are allowed. Equal rows are each judged. A single origin
    with most of the paths is dealt out `salts` ways."""
    kind = urls.schema["id"].dataType
    owner = lambda salt: F.concat(salt.cast("string"), F.lit(":"), F.col("origin")).alias("owner")
    asked = urls.select(owner(F.pmod(F.xxhash64("path"), F.lit(salts))), F.lit(True).alias("is_path"), "path", F.lit(None).cast("boolean").alias("allow"), "id")
    own = rules.filter("path <> '' AND allow IS NOT NULL AND origin IS NOT NULL").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    own = own.select(owner(F.col("salt")), F.lit(False).alias("is_path"), "path", "allow", F.lit(None).cast(kind).alias("id"))
    dealt = asked.unionByName(own).repartition("owner").sortWithinPartitions("owner", "is_path")
    return dealt.mapInArrow(_decide, f"id {kind.simpleString()}, path string, allowed boolean, rule string")
