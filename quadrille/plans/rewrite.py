"""Replacing placeholders by chosen predicates, grouped by endpoint."""

from __future__ import annotations

import copy

from .sparql import GENERIC, Filter, Group, Optional_, Query, Service, Triple, Union_, parse, show, walk

_ALIASES = ("predicate", "uri", "iri", "p", "property")


def normalise_mapping(mapping: dict) -> dict[str, tuple[str, str]]:
    """``{generic: (endpoint, predicate)}`` of nested forms: under ``mapping.selected``,
    under ``selected``, or bare; the first endpoint that names a predicate counts."""
    if not isinstance(mapping, dict):
        return {}
    if isinstance(mapping.get("mapping"), dict):
        mapping = mapping["mapping"].get("selected", {})
    elif "selected" in mapping:
        mapping = mapping["selected"]
    out: dict[str, tuple[str, str]] = {}
    for generic, per in (mapping.items() if isinstance(mapping, dict) else ()):
        for endpoint, value in (per.items() if isinstance(per, dict) else ()):
            value = value[0] if isinstance(value, list) and value else value
            p = next((value[k] for k in _ALIASES if value.get(k)), None) if isinstance(value, dict) else value
            if isinstance(p, str) and p:
                out[generic if str(generic).startswith(GENERIC) else f"{GENERIC}{generic}"] = (endpoint, p)
                break
    return out


def _iri(text: str) -> str:
    return "<" + text.strip("<> ").replace(" ", "") + ">"


def rewrite_tree(q: Query, chosen: dict[str, tuple[str, str]], urls: dict[str, str], compat_grouping: bool = False) -> Query:
    """A copy of the query in which each placeholder triple with a chosen predicate stands,
    with the others of its endpoint and block, in one SERVICE where the first of them
    stood. Blocks keep union branches and OPTIONALs apart; ``compat_grouping`` knows only
    two contexts, inside and outside OPTIONAL, and may so change a query's meaning. What has
    no chosen predicate or no address stays."""
    q = copy.deepcopy(q)
    services: dict[tuple, Service] = {}
    gone: list[tuple[Group, object]] = []
    for group, i, x, optional in list(walk(q.where)):
        if not isinstance(x, Triple) or x.p not in chosen:
            continue
        endpoint, predicate = chosen[x.p]
        url = urls.get(endpoint) or (endpoint if endpoint.startswith("http") else None)
        if not url:
            continue
        key = (url, optional) if compat_grouping else (url, id(group))
        triple = Triple(x.s, _iri(predicate), x.o)
        if key in services:
            services[key].group.items.append(triple)
            gone.append((group, x))
        else:
            services[key] = Service(_iri(url)[1:-1], Group([triple]))
            group.items[i] = services[key]
    for group, x in gone:
        group.items = [y for y in group.items if y is not x]
    return q


def rewrite(text: str, mapping: dict, endpoints: dict[str, str], compat_grouping: bool = False) -> str:
    return show(rewrite_tree(parse(text), normalise_mapping(mapping), endpoints, compat_grouping))


def split_prologue(text: str) -> tuple[str, str]:
    q = parse(text)
    at = text.find(q.prologue) + len(q.prologue) if q.prologue else 0
    return text[:at].rstrip(), text[at:].lstrip()


__all__ = ["Filter", "Optional_", "Union_", "normalise_mapping", "rewrite", "rewrite_tree", "split_prologue"]
