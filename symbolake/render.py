"""Results as markdown. Input are plain dictionaries of bounded size, as `session.Session` returns them."""

from __future__ import annotations


def _node(n: dict) -> str:
    extra = "".join([f" · {n['repo']}" if n.get("repo") else "", f": {n['summary']}" if n.get("summary") else ""])
    return f"- **{n['name']}** _{n['kind']}_ `{n['location']}`{extra} (id `{n['symbol_id']}`)"


def _hop(h: dict) -> str:
    return f"{'  ' * (h['depth'] - 1)}- **{h['name']}** _{h['kind']}_ `{h['location']}` · {h['repo']} (via {h['via'].lower()}, depth {h['depth']})"


def _page(title: str, lines: list[str], none: str) -> str:
    return "\n".join([f"## {title}", "", *(lines or [f"_{none}_"]), ""])


def _missing(tool: str, focus: str) -> str:
    return _page(f"{tool} `{focus}`", [], "no symbol matched; use find to get its id")


def search(d: dict) -> str:
    return _page(f"search: {d['query']}", [_node(n) + f" score {n['score']:.4f}, {n['deps']} dependents" for n in d["results"]], d.get("note") or "nothing found")


def repos(d: dict) -> str:
    return _page("Repositories", [f"- **{r['repo']}**: {r['symbols']} symbols" for r in d["repos"]], "none")


def suggest(d: dict) -> str:
    lines, last = [], None
    for s in d["suggestions"]:
        if (s["symbol"], s["location"]) != last:
            last = (s["symbol"], s["location"])
            lines.append(f"**{s['symbol']}** `{s['location']}`")
        lines.append(f"- {s['question']}")
    return _page(f"Suggested questions ({len(d['suggestions'])} of {d['total']})", lines, "none")


def find(d: dict) -> str:
    return _page(f"find: {d['query']}", [_node(n) for n in d["results"]], "no symbols matched")


def zoom(d: dict) -> str:
    if not d["found"]:
        return _missing("zoom", d["query"])
    out = [_page(f"{d['focus']['name']}", [_node(d["focus"])] + ([f"```\n{d['focus']['signature']}\n```"] if d["focus"].get("signature") else []), "")]
    for title in ("container", "members", "callers", "callees", "importers"):
        nodes = d[title] if isinstance(d[title], list) else [d[title]] if d[title] else []
        if nodes:
            out.append("\n".join([f"**{title}** ({len(nodes)})", *map(_node, nodes), ""]))
    return "\n".join(out)


def ripple(d: dict) -> str:
    if not d["found"]:
        return _missing("ripple", d["focus"])
    head = [f"{d['total_dependents']} dependents", "", *(f"- {r['repo']}: {r['symbols']}" for r in d["by_repo"]), ""]
    return _page(f"ripple `{d['focus']}`", head + [_hop(h) for h in d["dependents"]], "none")


def thread(d: dict) -> str:
    return _page(f"thread `{d['focus']}`", [_hop(h) for h in d["trace"]], "no calls")


def flow(d: dict) -> str:
    if not d["found"]:
        return _missing("flow", d["focus"])
    told = [d["narration"], "", *(f"- {q}" for q in d["queries"]), ""] if d["narration"] else []
    return _page(f"flow `{d['focus']}`", told + [_hop(h) for h in d["trace"]], "no calls")


def context_pack(d: dict) -> str:
    if not d["found"]:
        return _missing("context_pack", d["focus"])
    lines = [f"- **{i['name']}** `{i['location']}` {i['est_tokens']} tokens" + (f": {i['summary']}" if i.get("summary") else "") for i in d["items"]]
    return _page(f"context_pack `{d['focus']}` ({d['est_total_tokens']} of {d['token_budget']} tokens)", lines, "empty")


def guide(d: dict) -> str:
    return d["guide"] if d["found"] else _page("guide", [], "no style guide is stored")


def stats(d: dict) -> str:
    return _page("Statistics", [f"- {r['repo']} {r['kind']}: {r['symbols']} symbols, {r['enriched']} enriched, {r['edges']} edges" for r in d["stats"]], "none")
