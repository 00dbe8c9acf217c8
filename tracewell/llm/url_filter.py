"""URL verdicts from a sorted array of 64-bit digests.

Rules are strings, host then path. Their xxhash64 digests lie sorted in a file that each worker
memory-maps; the full strings lie beside it. For every url the strings that could be a rule
(each suffix of its host at a label's start that is as long as some rule's host, with its path cut
to each length that such a rule's path has) are hashed and probed by one vectorised binary search
a batch. A digest that is found
counts only if the stored string is the same, so collisions are harmless.

A rule fits its host and all subdomains if the url's path starts with the rule's path (an empty
path starts with no rule's slash). The longest rule wins; of two equally long ones that of the
longer host. Urls that no rule fits are allowed.

The file is written to the session's shared folder, and Spark brings it to every executor.

Edge cases: a null url or one without ``://`` has empty host and path, which no rule fits; a very
long host is read only as far from its end as the longest rule's host, and a url costs at most one
probe for each pair of lengths that a rule has, however many labels it has; repeated rows are judged each; an empty
table gives an empty result; other columns are not carried. Rules of more than ``MAX_BYTES`` are
an error: split them and take the longest of the rules found.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from ._spark import prepare, table

RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
DEFAULT = "allow"
#: Rule sets above this many bytes are refused: every worker maps them whole.
MAX_BYTES = 4 << 30

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_OPEN: dict[str, "RuleFile"] = {}


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of a url."""
    at = url.find("://") if url is not None else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    for stop in "?#":
        rest = rest.partition(stop)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_UPPER), slash + path


class RuleFile:
    """A digest file, memory-mapped: a header, sorted digests, ends of the strings, the strings."""

    def __init__(self, path: str):
        head = np.memmap(path, dtype="<u8", mode="r", shape=(2,))
        n, k = int(head[0]), int(head[1])
        pairs = np.memmap(path, dtype="<u8", mode="r", offset=16, shape=(k, 2)).tolist() if k else []
        #: Length of a rule's host, to the lengths of the paths of such rules.
        self.lengths: dict[int, list[int]] = {}
        for host, length in pairs:
            self.lengths.setdefault(host, []).append(length)
        self.longest = max(self.lengths, default=0)
        at = 16 + 16 * k
        self.digests = np.memmap(path, dtype="<u8", mode="r", offset=at, shape=(n,)) if n else np.zeros(0, dtype="<u8")
        self.ends = np.memmap(path, dtype="<u8", mode="r", offset=at + 8 * n, shape=(n + 1,))
        self.strings = np.memmap(path, dtype=np.uint8, mode="r", offset=at + 16 * n + 8, shape=(max(int(self.ends[-1]), 1),))

    def stored(self, k: int) -> tuple[bytes, bool]:
        raw = self.strings[int(self.ends[k]) : int(self.ends[k + 1])].tobytes()
        return raw[:-1], raw[-1:] == b"B"

    def find(self, keys: list[bytes]) -> list[bool | None]:
        """For each key None if no rule has it, else whether that rule blocks."""
        if not keys or not len(self.digests):
            return [None] * len(keys)
        wanted = np.fromiter(map(xxhash.xxh64_intdigest, keys), dtype=np.uint64, count=len(keys))
        low, high = np.searchsorted(self.digests, wanted, "left"), np.searchsorted(self.digests, wanted, "right")
        out: list[bool | None] = [None] * len(keys)
        for k in np.flatnonzero(high > low):
            for place in range(low[k], high[k]):
                string, blocks = self.stored(place)
                if string == keys[k]:
                    out[k] = blocks
                    break
        return out


def packed_rules(rules: dict[str, str]) -> list[bytes]:
    """The parts of a digest file; ``rules``: host and path, to ``allow`` or ``block``."""
    rows = sorted((xxhash.xxh64_intdigest(k.encode()), k.encode(), v == "block") for k, v in rules.items())
    if sum(len(k) + 17 for _, k, _ in rows) > MAX_BYTES:
        raise ValueError("the rules exceed MAX_BYTES; split them over several passes")
    lengths = sorted({(k.find("/"), len(k) - k.find("/")) for k in rules})
    ends = np.cumsum([0] + [len(k) + 1 for _, k, _ in rows])
    numbers = [len(rows), len(lengths), *(n for pair in lengths for n in pair), *[d for d, _, _ in rows], *ends]
    return [np.array(numbers, dtype="<u8").tobytes(), b"".join(k + (b"B" if blocks else b"A") for _, k, blocks in rows) or b"\0"]


def judge(urls: list[str | None], rules: RuleFile) -> list[tuple[str, str, str | None, str | None]]:
    """Host, path, rule and the rule's verdict of each url."""
    parts, keys, whose = [split_url(u) for u in urls], [], []
    for k, (host, path) in enumerate(parts):
        if not path:
            continue
        end, at = len(host), len(host)
        while at >= 0:  # labels from the last to the first, while a rule's host may be as long
            at = host.rfind(".", max(0, end - rules.longest - 1), at)
            size = end - at - 1
            if at < 0 and size > rules.longest:
                break
            for n in rules.lengths.get(size, ()):
                if n <= len(path):
                    keys.append((host[at + 1 :] + path[:n]).encode("utf-8", "surrogatepass"))
                    whose.append((k, size + n, size))
    best: dict[int, tuple[int, int, str, bool]] = {}
    for (k, size, host_size), key, blocks in zip(whose, keys, rules.find(keys), strict=True):
        if blocks is not None and (k not in best or (size, host_size) > best[k][:2]):
            best[k] = (size, host_size, key.decode("utf-8", "surrogatepass"), blocks)
    return [(*p, *((best[k][2], "block" if best[k][3] else "allow") if k in best else (None, None))) for k, p in enumerate(parts)]


def filter_urls(rows: DataFrame, rules: dict[str, str] | None = None, key: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """The verdict on each row's url."""
    sc = prepare(rows.sparkSession).sparkContext
    rules = RULES if rules is None else rules
    name = "urlrules-" + hashlib.sha256(repr(sorted(rules.items())).encode()).hexdigest()[:16]
    if not any(x.endswith(name) for x in sc.listFiles):
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{sc.getCheckpointDir()}/{name}")
        out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
        for part in packed_rules(rules):
            for lo in range(0, len(part), 1 << 24):
                out.write(bytearray(part[lo : lo + (1 << 24)]))
        out.close()
        sc.addFile(path.toString())  # Spark sends it to every executor, also to those that replace lost ones

    def batches(it):
        path = SparkFiles.get(name)
        file = _OPEN.get(path) or _OPEN.setdefault(path, RuleFile(path))
        for batch in it:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                found = judge(part.column(1).to_pylist(), file)
                cols = list(zip(*found, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(c, pa.string()) for c in cols[:3]], pa.array([v or default for v in cols[3]], pa.string())],
                    names=[key, "host", "path", "rule", "verdict"],
                )

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, url).mapInArrow(batches, f"{key} {kind}, host string, path string, rule string, verdict string")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def _fits(rule: str) -> str:
    host, slash, path = rule.partition("/")
    path = slash + path
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


ORACLE = {
    "op4_url_filter": f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
b AS (SELECT page_id, coalesce(regexp_extract(rest, '^([^?#]*)', 1), '') AS rest FROM a),
c AS (SELECT page_id, translate(regexp_extract(rest, '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM b),
d AS (SELECT *, CASE {" ".join(f"WHEN {_fits(r)} THEN '{r}'" for r in sorted(RULES, key=lambda r: (-len(r), -r.find("/"))))} END AS rule FROM c)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in RULES.items())} ELSE '{DEFAULT}' END AS verdict FROM d""",
}
