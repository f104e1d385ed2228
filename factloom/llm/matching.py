"""Matching client descriptions to an inventory without a common key: regularised Gaussian mixtures without labels.

Both sides are brought to the same parts: the two words of the thing's name, kind, environment and site. A client may
give each of them in several places and notations (logical name, URL template, resolved URL, host, database, contract
path, configuration source), shortened, misspelt, run together or in another order. Candidates are the inventory items
whose words the client's words can mean. Each candidate pair has a similarity vector: name, number of places that
agree, kind, environment, site, and how far the next best name is away.

Vectors of matched and unmatched pairs are two Gaussians with a covariance regularised by a ridge, fitted by
expectation-maximisation over all candidate pairs. Transitivity is enforced inside every E-step: inventory items are
different things, so two of them can't both be the client's, and the posteriors of one client's candidates compete and
add up to at most one. The result has the posterior as confidence, and whether the exact check holds that follows for
what counts as found: environment, site and kind are stated by the client and agree, and the best name is the only best.

Blocking: a written token finds the words it may mean by their deletion neighbourhoods (what is left of both after leaving
out up to two letters), never by comparing it with every word; tokens run together are split where both halves have such
neighbours. Only the vocabulary of the inventory, a fixed, stated table, is broadcast for that; margins are taken over all
names it can mean, and every name goes on, so no candidate depends on how items are divided. Items are joined by name.
Clients are never compared with each other and never shuffled by a description, so a thing that draws most clients is
no hot key. EM reads the candidate table from the shared folder; the driver gets one set of moments per iteration.

Defined results: clients that name no environment or site, or no two-part name, match nothing; redelivered clients are
one (their candidates are the same rows); null ids are ignored; clashing extra columns aren't read; empty tables and
inventories give no rows; two items of one thing, kind, environment and site are a tie and match nothing.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.spans import map_rows
from factloom.session import cut

#: How environments, sites and kinds are written; fixed values.
ENVIRONMENTS = {"prod": "prod", "production": "prod", "prd": "prod", "live": "prod", "staging": "staging", "stage": "staging", "stg": "staging", "qa": "qa", "test": "qa", "tst": "qa", "dev": "dev", "development": "dev", "uat": "uat", "sandbox": "sandbox"}
KINDS = {
    "http": "http", "https": "http", "rest": "http", "web": "http", "grpc": "grpc", "rpc": "grpc", "postgres": "postgres", "postgresql": "postgres", "pg": "postgres", "mysql": "mysql", "mariadb": "mysql",
    "redis": "redis", "cache": "redis", "memcached": "redis", "kafka": "kafka", "stream": "kafka", "msk": "kafka", "kinesis": "kafka", "sqs": "sqs", "queue": "sqs", "amqp": "sqs", "rabbitmq": "sqs", "mongo": "mongo", "mongodb": "mongo",
}
#: Kinds a client's coarse kind may stand for.
COARSE = {"http": {"http", "grpc"}, "db": {"postgres", "mysql", "mongo"}, "cache": {"redis"}, "queue": {"sqs"}, "stream": {"kafka"}, "rpc": {"grpc"}}
SITE = re.compile(r"^[a-z]{2}\d{1,2}$")
GENERIC = frozenset("client default data source datasource api gateway ingress host url uri port http https grpc rpc jdbc corp example svc cluster local localhost lb internal public v1 v2 v3 id ref app release name service server db database connection config".split())


def tokens(s: str | None) -> list[str]:
    """Lower-case words; camel case split, sites like eu-1 put together."""
    s = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", s or "")
    s = re.sub(r"(?i)(?<![A-Za-z])([a-z]{2})[-_](\d)(?![A-Za-z0-9])", r"\1\2", s)
    return [t for t in re.split(r"[^a-zA-Z0-9]+", s.lower()) if t]


def places(ts: list[str]) -> tuple[set[str], set[str], list[str]]:
    """(environments, sites, other words)."""
    envs = {ENVIRONMENTS[t] for t in ts if t in ENVIRONMENTS}
    sites = {t for t in ts if SITE.match(t)}
    return envs, sites, [t for t in ts if t not in ENVIRONMENTS and not SITE.match(t) and t not in GENERIC and not t.isdigit()]


def without_secrets(url: str | None) -> str:
    """The URL without user information, query and what follows a path parameter."""
    return re.sub(r"/(?::\w+|\{\w*\})(?=/|$).*", "/", re.sub(r"//[^/@\s]*@(?=[\w$])", "//", url or "").split("?")[0])


@lru_cache(maxsize=200_000)
def distance(a: str, b: str, most: int = 2) -> int:
    """Edits between two words (insert, drop, change, swap of neighbours), or most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        before, row = row, new
        if min(new) > most:
            return most + 1
    return min(row[-1], most + 1)


def likeness(written: str, word: str) -> float:
    """How well a written token stands for a word: same, plural, shortened, misspelt."""
    if written == word:
        return 1.0
    if written == word + "s" or written == word + "es":
        return 0.98
    if len(written) >= 3 and word.startswith(written):
        return 0.92
    if len(written) >= 4 and distance(written, word, 1) <= 1:
        return 0.9
    if len(written) >= 6 and distance(written, word, 2) <= 2:
        return 0.72
    return 0.0


def _variants(w: str, most: int) -> set[str]:
    """The word with up to `most` letters left out: two words within that many edits share one."""
    out = level = {w}
    for _ in range(most):
        level = {x[:i] + x[i + 1 :] for x in level for i in range(len(x))}
        out = out | level
    return out


class Words:
    """Words that are found again from written tokens: by what is left of both after leaving letters out, and by beginnings."""

    def __init__(self, words: list[str]):
        self.words = frozenset(words)
        self.lengths = range(min(map(len, words), default=1), max(map(len, words), default=0) + 1)
        self._left: dict[str, list[str]] = defaultdict(list)
        self._begin: dict[str, list[str]] = defaultdict(list)
        for w in sorted(self.words):
            for v in _variants(w, 2):
                self._left[v].append(w)
            for n in range(3, len(w)):
                self._begin[w[:n]].append(w)
        self._within: dict[str, dict[str, int]] = {}
        self._meant: dict[str, list[tuple[str, float]]] = {}

    def within(self, w: str) -> dict[str, int]:
        """Words at most two edits away, with their distance."""
        if w not in self._within:
            if len(self._within) > 200_000:
                self._within.clear()
            near = {x for v in _variants(w, 2) for x in self._left.get(v, ())} if len(w) - 2 <= self.lengths.stop else set()
            self._within[w] = {x: d for x in near if (d := distance(w, x, 2)) <= 2}
        return self._within[w]

    def meant(self, w: str) -> list[tuple[str, float]]:
        """The words that a token may stand for, as far as they are about as likely as the likeliest."""
        if w not in self._meant:
            if len(self._meant) > 100_000:
                self._meant.clear()
            near = set(self.within(w)) if len(w) >= 4 else set()
            near |= {x for x in (w, w[:-1], w[:-2]) if x in self.words} | set(self._begin.get(w, ()))
            hits = sorted((x, s) for x in near if (s := likeness(w, x)))
            top = max((s for _, s in hits), default=0)
            self._meant[w] = [(x, s) for x, s in hits if s >= top - 0.05]
        return self._meant[w]


Name = tuple[str, str]


class Vocabulary:
    """The words of the inventory's two-part names, and what written words may mean by them."""

    def __init__(self, firsts: list[str], seconds: list[str]):
        self.first, self.second = Words(firsts), Words(seconds)
        self._whole: dict[str, list[tuple[Name, float]]] = {}
        self._names: dict[tuple, dict[Name, float]] = {}

    def joined(self, w: str) -> list[Name]:
        """The names that a token without separator is, letter by letter."""
        return [(w[:k], w[k:]) for k in self.first.lengths if w[:k] in self.first.words and w[k:] in self.second.words]

    def run_together(self, w: str) -> list[tuple[Name, float]]:
        """Names that a token without separator may mean."""
        if len(w) < 7:
            return []
        if w not in self._whole:
            if len(self._whole) > 50_000:
                self._whole.clear()
            if same := self.joined(w):
                self._whole[w] = [(n, 1.0) for n in same]
            else:
                near: dict[Name, float] = {}
                for k in range(max(1, self.first.lengths.start - 2), min(len(w), self.first.lengths.stop + 2)):
                    for x in {w, w[: k - 1] + w[k] + w[k - 1] + w[k + 1 :]}:  # neighbours may be swapped across the middle
                        for a, m in self.first.within(x[:k]).items():
                            for b, n in self.second.within(x[k:]).items():
                                if m + n <= 2 and (a[0] == w[0] or b[-1] == w[-1]) and (d := distance(w, a + b, 2)) <= 2:
                                    near[a, b] = 0.9 if d == 1 else 0.75
                top = max(near.values(), default=0)
                self._whole[w] = sorted((n, s) for n, s in near.items() if s == top)
        return self._whole[w]

    def names(self, ws: list[str], path: bool = False) -> dict[Name, float]:
        """Two-part names that the words of one place may mean, with their likeness."""
        key = (path, *ws)
        if key in self._names:
            return self._names[key]
        if len(self._names) > 100_000:
            self._names.clear()
        out: dict[Name, float] = {}
        for i, w in enumerate(ws):
            for pair, s in self.run_together(w):
                out[pair] = max(out.get(pair, 0), s)
            for j, v in enumerate(ws):
                if i == j or path and j < i:
                    continue
                for a, s in self.first.meant(w):
                    for b, t in self.second.meant(v):
                        q = min(s, t) * 0.75 + max(s, t) * 0.25 - (0.01 if j < i else 0) - 0.02 * (abs(j - i) - 1)
                        out[a, b] = max(out.get((a, b), 0), q)
        self._names[key] = out
        return out


class Inventory:
    """The items' descriptions, brought to the same parts."""

    @staticmethod
    def parts(kind, display, dns, address, env, site):
        """(kind, first word, second word, environments, sites) of one item."""
        envs, sites, pair = set(), set(), (None, None)
        for s in (display, dns, without_secrets(address)):
            e, x, w = places(tokens(s))
            envs |= e
            sites |= x
            w = [t for t in w if t not in KINDS]
            if pair[0] is None and len(w) >= 2:
                pair = (w[0], w[1])
        envs |= places(tokens(env))[0]
        sites |= places(tokens(site))[1]
        return KINDS.get((kind or "").strip().lower()), *pair, sorted(envs), sorted(sites)

    @staticmethod
    def from_path(path: str | None, vocabulary: Vocabulary) -> Name | None:
        """The name that a base route is built from, where nothing else says it."""
        w = places(tokens(path))[2]
        known = vocabulary.second.words
        second = next((x if x in known else x[:-1] for x in w[1:] if x in known or x[:-1] in known), None)
        return (w[0], second) if w and w[0] in vocabulary.first.words and second else None


VECTOR = 6


CLIENT = "client_id long, envs array<string>, sites array<string>, kinds array<string>, coarse array<string>, names array<struct<first:string,second:string,likeness:double,votes:int,margin:double>>"


def described(vocabulary: Vocabulary, kind, ref_kind, logical, template, resolved, host, database, config, path):
    """(environments, sites, stated kinds, kinds its coarse kind may be, names) of a client; names with likeness, votes and margin."""
    envs, sites = set(), set()
    found: list[dict[Name, float]] = []
    for s in (logical, without_secrets(template), without_secrets(resolved), host):
        e, x, w = places(tokens(s))
        envs |= e
        sites |= x
        w = [t for t in w if t not in KINDS or vocabulary.joined(t)]
        if w:
            found.append(vocabulary.names(w))
    envs |= places(tokens((config or "").split(":")[0]))[0]
    w = places(tokens(re.sub(r"[:{][\w}]+.*", "", path or "")))[2]
    if w:
        found.append(vocabulary.names(w[:2], path=True))
    domain = set(tokens(database))
    score: dict[Name, float] = {}
    votes: dict[Name, int] = defaultdict(int)
    for f in found:
        top = max(f.values(), default=0)
        for pair, s in f.items():
            score[pair] = max(score.get(pair, 0), s)
            votes[pair] += s >= top - 1e-9
    for pair in score:
        if pair[0] in domain:  # the database is named after the first part of the name
            score[pair] += 0.05
            votes[pair] += 1
    total = {p: s + 0.04 * votes[p] for p, s in score.items()}
    first, second = (sorted(total.values(), reverse=True) + [0.0, 0.0])[:2]
    names = []
    for pair, s in sorted(score.items()):
        other = second if total[pair] == first else first  # the best of the others; a tie leaves no margin
        names.append((*pair, min(s, 1.0), votes[pair], max(-1.0, min(1.0, (total[pair] - other) * 12))))
    stated = {KINDS[k] for k in [(ref_kind or "").strip().lower()] if k in KINDS}
    scheme = re.match(r"(?:jdbc:)?([a-z]+)", (template or resolved or "").lower())
    if not stated and scheme and KINDS.get(scheme[1]) in ("postgres", "mysql", "redis", "kafka", "grpc", "mongo"):
        stated = {KINDS[scheme[1]]}
    return sorted(envs), sorted(sites), sorted(stated), sorted(COARSE.get((kind or "").strip().lower(), ())), names


def parsed(inventory: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """items(item_id, kind, first, second, env, site) of which all parts are known, and the vocabulary of all items' names."""
    cols = ["kind", "display_name", "dns_name", "address", "env_name", "site_code"]
    raw = map_rows(
        inventory.where("item_id is not null").select("item_id", *cols, "path").distinct(),
        "item_id long, kind string, first string, second string, envs array<string>, sites array<string>, path string",
        lambda i, *rest: [(i, *Inventory.parts(*rest[:-1]), rest[-1])],
    )
    raw = cut(raw)
    words = lambda c: [r[0] for r in raw.where(F.col(c).isNotNull()).select(c).distinct().toLocalIterator()]
    vocabulary = Vocabulary(words("first"), words("second"))
    held = inventory.sparkSession.sparkContext.broadcast(vocabulary)

    def complete(i, kind, first, second, envs, sites, path):
        pair = (first, second) if first else Inventory.from_path(path, held.value)
        return [(i, kind, *pair, envs[0], sites[0])] if pair and kind and len(envs) == 1 and len(sites) == 1 else []

    return map_rows(raw, "item_id long, kind string, first string, second string, env string, site string", complete), vocabulary


def _vector(name, item, envs, sites, kinds, coarse) -> tuple[list[float], bool]:
    """The similarity vector of a client's name and an item of this name; whether environment, site and kind are stated and agree."""
    _, _, likeness_, votes, margin = name
    kind, env, site = item
    same_kind = 1.0 if kind in kinds else 0.0 if kinds else 0.9 if kind in coarse else 0.0 if coarse else 0.5
    same_env = 1.0 if envs == [env] else 0.5 if not envs or env in envs else 0.0
    same_site = 1.0 if sites == [site] else 0.5 if not sites or site in sites else 0.0
    return [likeness_, min(votes, 4) / 4, same_kind, same_env, same_site, margin], envs == [env] and sites == [site] and same_kind >= 0.9


CANDIDATES = "client_id long, candidates array<struct<item_id:long,vector:array<double>,stated:boolean>>"


def similarity(clients: DataFrame, inventory: DataFrame, most_broadcast: int = 200_000) -> DataFrame:
    """(client_id, candidates array<struct<item_id, vector, stated>>) of all clients with any candidate.

    Names are looked up in the vocabulary of the whole inventory. Up to most_broadcast items the items of a name are
    broadcast as well, and a client's row never leaves its task; more of them are joined by name. Both give the same rows.
    """
    spark = clients.sparkSession
    items, vocabulary = parsed(inventory)
    items = cut(items)
    held = spark.sparkContext.broadcast(vocabulary)
    ref = [F.col(f"instance_ref.{f}").alias(f"ref_{f}") for f in ("kind", "logical_name", "url_template", "resolved_url", "host", "database", "config_source")]
    narrow = clients.where("client_id is not null").select("client_id", "kind", *ref, "contract_path")
    if items.count() <= most_broadcast:
        of: dict[Name, list] = defaultdict(list)
        for r in items.orderBy("item_id").toLocalIterator():
            of[r["first"], r["second"]].append((r.item_id, (r.kind, r.env, r.site)))
        known = spark.sparkContext.broadcast(dict(of))

        def candidates(c, *rest):
            envs, sites, kinds, coarse, names = described(held.value, *rest)
            own = [(i, *_vector(n, item, envs, sites, kinds, coarse)) for n in names for i, item in known.value.get(n[:2], ())]
            return [(c, [{"item_id": i, "vector": v, "stated": s} for i, v, s in own])] if own else []

        return map_rows(narrow, CANDIDATES, candidates)

    def named(c, *rest):
        *parts, names = described(held.value, *rest)
        return [(c, *parts, [dict(zip(("first", "second", "likeness", "votes", "margin"), n)) for n in names])] if names else []

    # redelivered rows count as often as they come, as they do above
    n = map_rows(narrow, CLIENT, named).withColumn("row", F.monotonically_increasing_id()).withColumn("n", F.explode("names")).select("client_id", "row", "envs", "sites", "kinds", "coarse", "n.*")
    j = n.join(items.withColumnRenamed("kind", "item_kind"), ["first", "second"])
    place = lambda own, it: F.when(F.col(own) == F.array(it), 1.0).when((F.size(own) == 0) | F.array_contains(own, F.col(it)), 0.5).otherwise(0.0)
    kind = F.when(F.array_contains("kinds", F.col("item_kind")), 1.0).when(F.size("kinds") > 0, 0.0).when(F.array_contains("coarse", F.col("item_kind")), 0.9).when(F.size("coarse") > 0, 0.0).otherwise(0.5)
    vector = F.array("likeness", F.least("votes", F.lit(4)) / 4.0, kind, place("envs", "env"), place("sites", "site"), "margin")
    stated = (F.col("envs") == F.array("env")) & (F.col("sites") == F.array("site")) & (kind >= 0.9)
    return j.groupBy("client_id", "row").agg(F.collect_list(F.struct("item_id", vector.alias("vector"), stated.alias("stated"))).alias("candidates")).drop("row")


class Mixture:
    """Two Gaussians over similarity vectors: unmatched (0) and matched (1), with a ridge on both covariances."""

    def __init__(self, weight, means, covariances, ridge: float):
        import numpy as np

        self.weight, self.ridge = weight, ridge
        self.means = [np.asarray(m, dtype=float) for m in means]
        self.covariances = [np.asarray(c, dtype=float) + ridge * np.eye(len(m)) for c, m in zip(covariances, self.means)]
        self.inverse = [np.linalg.inv(c) for c in self.covariances]
        self.logdet = [np.linalg.slogdet(c)[1] for c in self.covariances]

    def odds(self, x):
        """Odds of matched to unmatched of each vector."""
        import numpy as np

        logs = []
        for k, w in ((0, 1 - self.weight), (1, self.weight)):
            d = x - self.means[k]
            logs.append(np.log(max(w, 1e-12)) - 0.5 * (np.einsum("ij,jk,ik->i", d, self.inverse[k], d) + self.logdet[k]))
        return np.exp(np.clip(logs[1] - logs[0], -700, 700))

    def posteriors(self, x, owner):
        """Posteriors under transitivity: of the candidates of one owner at most one is the match."""
        import numpy as np

        o = np.minimum(self.odds(x), 1e12)
        total = np.bincount(owner, weights=o)
        return o / (1.0 + total[owner])


def _arrays(column):
    """(vectors, owner index) of an Arrow column of candidate lists."""
    import numpy as np

    flat = column.flatten()
    x = np.asarray(flat.field("vector").flatten()).reshape(-1, VECTOR)
    owner = np.repeat(np.arange(len(column)), np.diff(np.asarray(column.offsets)))
    return x, owner, flat


def fit(candidates: DataFrame, ridge: float = 0.01, rounds: int = 12, tolerance: float = 1e-4) -> Mixture | None:
    """EM over all candidate pairs; each round the executors send one set of moments a batch, summed by the driver."""
    import numpy as np

    spark = candidates.sparkSession
    # start: a pair is matched as far as its weakest of name, kind, environment and site says so
    state: Mixture | None = None
    last = None
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(state)

        def moments(batches):
            import pyarrow as pa

            m = held.value
            for b in batches:
                x, owner, _flat = _arrays(b.column(0))
                if not len(x):
                    continue
                if m is None:
                    p = np.where(x[:, [0, 2, 3, 4]].min(axis=1) >= 0.85, 0.95, 0.02)
                else:
                    p = m.posteriors(x, owner)
                out = []
                for w in (1 - p, p):
                    out += [w.sum(), *(w @ x), *((x * w[:, None]).T @ x).ravel()]
                yield pa.RecordBatch.from_arrays([pa.array([out], pa.list_(pa.float64()))], names=["s"])

        n = 1 + VECTOR + VECTOR * VECTOR
        total = np.zeros(2 * n)
        parts = candidates.select("candidates").mapInArrow(moments, "s array<double>")
        for r in parts.select(*(F.sum(F.col("s")[i]).alias(f"m{i}") for i in range(2 * n))).collect():
            total = np.array([v or 0.0 for v in r], dtype=float)
        if not total[0] + total[n]:
            return None
        means, covs = [], []
        for t in (total[:n], total[n:]):
            w = max(t[0], 1e-9)
            mu = t[1 : 1 + VECTOR] / w
            means.append(mu)
            covs.append(np.clip(t[1 + VECTOR :].reshape(VECTOR, VECTOR) / w - np.outer(mu, mu), -1, 1))
        state = Mixture(total[n] / (total[0] + total[n]), means, covs, ridge)
        here = np.concatenate([[state.weight], *means])
        if last is not None and np.abs(here - last).max() < tolerance:
            break
        last = here
    return state


def match(clients: DataFrame, inventory: DataFrame, least: float = 0.5, most_broadcast: int = 200_000, **fitting) -> DataFrame:
    """(client_id, item_id, confidence, stated): pairs whose posterior is at least `least`, at most one item a client.

    stated: the client itself says environment, site and kind, and the best name leaves the others behind. Pairs that aren't
    stated follow from what the inventory holds; their confidence is what the mixture makes of them.
    """
    spark = clients.sparkSession
    pairs = cut(similarity(clients, inventory, most_broadcast))
    mixture = fit(pairs, **fitting)
    schema = "client_id long, item_id long, confidence double, stated boolean"
    if mixture is None:
        return spark.createDataFrame([], schema)
    held = spark.sparkContext.broadcast(mixture)

    def decide(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            x, owner, flat = _arrays(b.column(1))
            if not len(x):
                continue
            p = held.value.posteriors(x, owner)
            best = np.zeros(len(b.column(0)))
            np.maximum.at(best, owner, p)
            stated = np.asarray(flat.field("stated")) & (x[:, 5] > 0)
            tie = np.bincount(owner, weights=(p >= best[owner] - 1e-9).astype(float))
            ok = (p >= best[owner] - 1e-9) & (tie[owner] == 1) & (p >= least)
            if ok.any():
                i = np.flatnonzero(ok)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(owner[i])), flat.field("item_id").take(pa.array(i)), pa.array(p[i]), pa.array(stated[i])], names=["client_id", "item_id", "confidence", "stated"]
                )

    return pairs.mapInArrow(decide, schema).groupBy("client_id", "item_id").agg(F.max("confidence").alias("confidence"), F.max("stated").alias("stated"))
