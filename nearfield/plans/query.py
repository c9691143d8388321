"""The query strings: ``[total&]level:id#k[,id#k][;level:...]||v v ...[;v v ...][||key=value,...]`` and build strings."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


def _split(text: str, sep: str) -> list[str]:
    return [p for p in text.split(sep) if p]


@dataclass(frozen=True)
class Quota:
    level: int
    id: int
    k: int


@dataclass(frozen=True)
class Query:
    groups: tuple[Quota, ...]
    vectors: tuple[tuple[float, ...], ...]
    total: int = 0
    ages: tuple[tuple[int, int], ...] = ()
    params: dict[str, str] = field(default_factory=dict)

    @property
    def everything(self) -> bool:
        return any(g.level == 0 for g in self.groups)

    def boosted(self, ratio: float) -> Query:
        """All quotas and the total times ``ratio``."""
        return replace(self, total=int(self.total * ratio), groups=tuple(replace(g, k=int(g.k * ratio)) for g in self.groups), ages=tuple((a, int(k * ratio)) for a, k in self.ages))


def _vectors(text: str, binary: bool) -> tuple[tuple[float, ...], ...]:
    out = []
    for part in _split(text, ";"):
        v = tuple(float(x) for x in _split(part, " "))
        if binary and set(v) - {0.0, 1.0}:
            raise ValueError("a binary vector has 0 and 1 only")
        out.append(v)
    if not out:
        raise ValueError("a query without vector")
    return tuple(out)


def parse_search(text: str, binary: bool = False) -> Query:
    parts = _split(text, "||")
    if not 1 <= len(parts) <= 3:
        raise ValueError("a query has one to three parts")
    if len(parts) == 1:
        return Query((), _vectors(parts[0], binary))
    params = {}
    for p in _split(parts[2], ",") if len(parts) == 3 else []:
        k, _, v = p.partition("=")
        params[k.strip()] = v.strip()
    ages, total = (), 0
    if age := params.get("multi_age_mode"):
        pairs = [tuple(int(x) for x in p.split("#")) for p in _split(age, ";")]
        ages = tuple(sorted((5400 if a == 3600 else a, k) for a, k in pairs))
        return Query((Quota(0, 0, sum(k for _, k in ages)),), _vectors(parts[1], binary), sum(k for _, k in ages), ages, params)
    head, sep, rest = parts[0].partition("&")
    if sep:
        total = int(head)
    groups = []
    for g in _split(rest if sep else head, ";"):
        level, colon, ids = g.partition(":")
        if not colon:
            raise ValueError(f"not a group: {g}")
        for i in _split(ids, ","):
            name, mark, k = i.partition("#")
            if not mark:
                raise ValueError(f"a group without quota: {i}")
            groups.append(Quota(int(level), int(name), int(k)))
    if not groups:
        raise ValueError("a search without groups")
    return Query(tuple(groups), _vectors(parts[1], binary), total, ages, params)


def parse_build(text: str, binary: bool = False) -> tuple[tuple[tuple[int, int], ...], tuple[float, ...]]:
    """(groups sorted by level and id, vector); without groups the one of level 0."""
    parts = _split(text, "||")
    if not 1 <= len(parts) <= 2:
        raise ValueError("a record has one or two parts")
    groups = [tuple(int(x) for x in g.split(":")) for g in _split(parts[0], ";")] if len(parts) == 2 else [(0, 0)]
    if len(set(groups)) < len(groups):
        raise ValueError("a group twice")
    return tuple(sorted(groups)), _vectors(parts[-1], binary)[0]


def rows(queries: list[Query]) -> list[tuple]:
    """(qid, qv, level, id, pool_id, k): vector i goes with group i where there are several vectors; one quota alone is the total, if given."""
    out = []
    for n, q in enumerate(queries):
        if len(q.vectors) > 1 and len(q.vectors) != len(q.groups):
            raise ValueError("as many vectors as groups are needed")
        for i, g in enumerate(q.groups):
            k = q.total or g.k if len(q.groups) == 1 else g.k
            out.append((n, list(q.vectors[i if len(q.vectors) > 1 else 0]), g.level, g.id, i, k))
    return out
