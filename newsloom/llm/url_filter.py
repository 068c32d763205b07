"""URL rules by a bit-parallel wildcard automaton.

Every glob becomes a run of bits in a row of 64-bit words: a start bit, then
one bit for each literal byte. One Shift-And step moves all patterns at once,

    D' = ((D << 1) & B[c]) | (D & S[c])

where B[c] holds the bits whose byte is c, and S[c] the bits that a wildcard
lets stay on c. ``~`` stands for any bytes but ``/`` (so it cannot leave the
host), ``*`` for any bytes. The canonical URL is host and path, the host in
lower case, scheme, query and fragment gone. All URLs of a batch step together.

Defined results. A null URL, or one without ``://``, has an empty host and
path; no rule fits it and the verdict is the default. Repeated rows are judged
alike. A rule fits its host and all subdomains where the path starts with the
rule's; among those that fit, the longest wins (ties: the first given). Where
none fits, the longest matching glob of ``globs`` decides, else ``default``. An
empty table gives no row. A very long URL takes a step for each byte, and the
others of its batch wait for it. Further columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.arrow import as_bytes, portions

#: The contract's rules, (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: What decides where no rule fits: hosts that sell bets and pills.
GLOBS = (("block", "~casino*"), ("block", "~free-bets*"), ("block", "~cheap-pills*"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Globs:
    """Patterns packed into multiword Shift-And masks."""

    def __init__(self, patterns: list[str]):
        layout = []
        for p in patterns:
            bits: list[list] = [[None, None]]  # literal byte, class of the wildcard behind it
            for b in p.encode():
                if b in b"~*":
                    bits[-1][1] = "*" if b == 0x2A or bits[-1][1] == "*" else "~"
                else:
                    bits.append([b, None])
            layout.append(bits)
        total = sum(map(len, layout))
        self.words = max(1, -(-total // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.final: list[tuple[int, np.uint64]] = []
        at = 0
        for bits in layout:
            for k, (literal, star) in enumerate(bits):
                word, bit = at // 64, np.uint64(1 << at % 64)
                if k == 0:
                    self.start[word] |= bit
                else:
                    self.step[literal, word] |= bit
                if star:
                    self.stay[:, word] |= bit
                    if star == "~":
                        self.stay[0x2F, word] &= ~bit
                at += 1
            self.final.append((word, bit))

    def match(self, urls: list[bytes]) -> np.ndarray:
        """urls x patterns, true where the whole URL fits the pattern."""
        lengths = np.fromiter(map(len, urls), np.int64, len(urls))
        order = np.argsort(-lengths, kind="stable")
        ends = -lengths[order]
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1][order]
        text = np.frombuffer(b"".join(urls), np.uint8)
        state = np.tile(self.start, (len(urls), 1))
        one, top = np.uint64(1), np.uint64(63)
        for i in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(ends, -i, side="left"))  # those longer than i come first
            d, c = state[:live], text[starts[:live] + i]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            state[:live] = (moved & self.step[c]) | (d & self.stay[c])
        out = np.empty((len(urls), len(self.final)), bool)
        for k, (word, bit) in enumerate(self.final):
            out[order, k] = (state[:, word] & bit) != 0
        return out


def host_of(url: Column) -> Column:
    """From behind the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = _rest(url)
    return F.regexp_extract(F.regexp_replace(rest, "^[^/?#]*", ""), "^[^?#]*", 0)


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def judge(pages: DataFrame, rules=RULES, globs=GLOBS, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per page: the id, host, path, the rule that decided (else null) and the verdict."""
    rules, globs = list(rules), list(globs)
    if not {v for v, *_ in [*rules, *globs]} <= {"allow", "block"}:
        raise ValueError("a verdict is allow or block")
    kind = pages.schema[id_col].dataType.simpleString()
    patterns = [p for _, h, path in rules for p in (f"{h}{path}*", f"~.{h}{path}*")] + [g for _, g in globs]
    longest = sorted(range(len(rules)), key=lambda k: (-len(rules[k][1] + rules[k][2]), k))
    longest_glob = sorted(range(len(globs)), key=lambda k: (-len(globs[k][1]), k))

    def run(batches):
        packed = Globs(patterns)
        for batch in batches:
            for part in portions(batch, 4096):
                hosts, paths = as_bytes(part.column(1)), as_bytes(part.column(2))
                fits = packed.match([h + p for h, p in zip(hosts, paths, strict=True)])
                n = part.num_rows
                rule, verdict = np.full(n, None, object), np.full(n, default, object)
                for k in reversed(longest_glob):
                    verdict[fits[:, 2 * len(rules) + k]] = globs[k][0]
                for k in reversed(longest):
                    found = fits[:, 2 * k] | fits[:, 2 * k + 1]
                    rule[found], verdict[found] = rules[k][1] + rules[k][2], rules[k][0]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["id", "host", "path", "rule", "verdict"])

    url = F.col(url_col)
    out = pages.select(F.col(id_col).alias("id"), F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"))
    return out.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)


SQL = f"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), named AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM parts
), rules(verdict, h, p) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}), judged AS (
  SELECT page_id, host, path,
         (SELECT max_by(h || p, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule
  FROM named
)
SELECT j.page_id, host, path, rule,
       coalesce(r.verdict, CASE WHEN {" OR ".join(f"contains(host, '{g.strip('~*')}')" for _, g in GLOBS)} THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN rules r ON j.rule = r.h || r.p
"""
