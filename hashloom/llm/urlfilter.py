"""URL filtering with a bit-parallel wildcard automaton.

All glob rules are packed into one multiword Shift-And automaton and simulated at once over each
canonical URL (lower-cased host followed by the path).  A rule of ``m`` symbols takes ``m + 1`` bits,
one for each number of symbols consumed.  On a character ``c`` the state becomes::

    ((state << 1) & reach[c]) | (state & loop)

``reach[c]`` has a bit for each position that ``c`` leads to, ``loop`` one for each position where the
glob has ``*``.  Shifts carry across words.  URLs are simulated in batches: one numpy step advances
every URL of the batch by one byte, so the work is (longest URL) x (words), whatever the number of rules
that match.  ``?`` stands for one byte, ``*`` for any run of bytes, empty ones included.  As ``*`` runs
across slashes too, what the automaton finds for a rule is held against the host and the path before it counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A host and path-prefix rule; it fits the host and all its subdomains."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def globs(self) -> tuple[str, str]:
        return f"{self.name}*", f"*.{self.name}*"

    def fits(self, host: str, path: str) -> bool:
        return (host == self.host or host.endswith("." + self.host)) and path.startswith(self.path)


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)
#: What the filter itself blocks where no rule fits.
BLOCKED_GLOBS = ("*casino*", "*porn*", "*viagra*", "*/wp-admin/*", "*/login*", "*.exe", "*.zip", "*poker-?*", "*free-money*", "*/cart/*")


class Automaton:
    """Compiled globs; ``match(urls)`` gives a boolean matrix of URLs by globs."""

    def __init__(self, globs: Sequence[str]):
        self.globs = [g.encode() for g in globs]
        bits = sum(len(g.replace(b"*", b"")) + 1 for g in self.globs)
        self.words = max(1, -(-bits // 64))
        reach = np.zeros((256, self.words * 64), bool)
        loop, start, final = (np.zeros(self.words * 64, bool) for _ in range(3))
        self.ends = []
        at = 0
        for g in self.globs:
            start[at] = True
            for c in g:
                if c == ord("*"):
                    loop[at] = True
                    continue
                at += 1
                if c == ord("?"):
                    reach[:, at] = True
                else:
                    reach[c, at] = True
            final[at] = True
            self.ends.append(at)
            at += 1
        pack = lambda x: np.packbits(x, axis=-1, bitorder="little").view(np.uint64)
        self.reach, self.loop, self.start = pack(reach), pack(loop), pack(start)

    def match(self, urls: Sequence[bytes]) -> np.ndarray:
        lengths = np.fromiter(map(len, urls), np.int64, len(urls))
        order = np.argsort(-lengths, kind="stable")
        flat = np.frombuffer(b"".join(urls), np.uint8)
        begin = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        state = np.repeat(self.start[None], len(urls), 0)
        one, carry = np.uint64(1), np.uint64(63)
        live = len(urls)
        for step in range(int(lengths[0]) if live else 0):
            live = int(np.searchsorted(-lengths, -step))  # URLs longer than step
            s = state[:live]
            moved = s << one
            moved[:, 1:] |= s[:, :-1] >> carry
            moved &= self.reach[flat[begin[:live] + step]]
            state[:live] = moved | (s & self.loop)
        out = np.empty((len(urls), len(self.ends)), bool)
        for k, e in enumerate(self.ends):
            out[order, k] = (state[:, e // 64] >> np.uint64(e % 64)) & one
        return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[Rule] = RULES, blocked: Sequence[str] = BLOCKED_GLOBS, batch: int = 4096) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for each row.

    The longest rule that fits decides (ties: the one listed first); without one the verdict is ``block`` when any blocked glob
    matches the canonical URL in lower case, else ``allow``.  Null URLs and those without ``://`` have an empty host and path,
    which no rule fits.  Repeated rows are judged each; a null id is kept; only the two columns are read.
    Rules are tables of the caller, of bounded size; a glob's text is taken as UTF-8 bytes.
    """
    rule_globs = [g for r in rules for g in r.globs]
    by_length = sorted(range(len(rules)), key=lambda k: -len(rules[k].name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, bad = Automaton(rule_globs), Automaton(blocked)
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                parts = [split_url(u) for u in b.column(1).to_pylist()]
                canonical = [(h + p).encode("utf-8", "replace") for h, p in parts]
                hit = fits.match(canonical)
                blocks = bad.match([c.lower() for c in canonical]).any(axis=1)
                rule: list[str | None] = [None] * len(parts)
                verdict = np.where(blocks, "block", "allow").astype(object)
                for k in reversed(by_length):
                    for row in np.flatnonzero(hit[:, 2 * k] | hit[:, 2 * k + 1]):
                        if rules[k].fits(*parts[row]):
                            rule[row], verdict[row] = rules[k].name, rules[k].verdict
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h for h, _ in parts]), pa.array([p for _, p in parts]), pa.array(rule, pa.string()), pa.array(list(verdict), pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def oracle_sql(rules: Sequence[Rule] = RULES, blocked: Sequence[str] = BLOCKED_GLOBS) -> str:
    """The same result as DuckDB SQL over ``pages``."""
    named = ", ".join(f"('{r.host}', '{r.path}', '{r.name}', '{r.verdict}', {k})" for k, r in enumerate(rules))
    like = " or ".join("lower(host || path) like '" + g.replace("_", "\\_").replace("*", "%").replace("?", "_") + "' escape '\\'" for g in blocked)
    return f"""
    with rules(rh, rp, name, verdict, k) as (values {named}),
    rest as (select row_number() over () rn, page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end r from pages),
    cut as (select rn, page_id, regexp_extract(r, '^[^?#]*', 0) r from rest),
    parts as (select rn, page_id, translate(regexp_extract(r, '^[^/]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, case when strpos(r, '/') > 0 then substr(r, strpos(r, '/')) else '' end path from cut),
    fit as (select rn, name, verdict, row_number() over (partition by rn order by length(name) desc, k) o from parts join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
    select page_id, host, path, fit.name as rule, coalesce(fit.verdict, case when {like} then 'block' else 'allow' end) as verdict
    from parts left join fit on parts.rn = fit.rn and o = 1"""
