"""Trains the page labeller: python -m marlstone.llm.train_pages TABLE.parquet OUT.npz [EVALUATION.parquet]

No labels are given, so layout rules make weak ones: what stands in a page's title element, its table of facts, its
description, reviews and replies, by element names and classes that shop and forum software uses, and sets of notices that
stand alone on bare pages. The bound of the sample is MAX_PAGES pages, by hash of their address. The network doesn't see the rules, only
paths and words, and class names that look random are one token; so it also labels layouts whose classes tell nothing.
"""

from __future__ import annotations

import re
import sys
import zlib

import numpy as np

from . import page_labeller as M
from .pages import leaves

MAX_PAGES = 6000
EPOCHS = 5
PAGES_A_STEP = 32
HOLD_OUT = False  # also train without a fifth of the sites and test on them

# Labels of the price in tables of facts.
PRICE_LABELS = {"price", "preis", "prix", "precio", "preço", "цена"}
_TITLE = {"div.ttl", "h2", "div.post-title"}
_BODY = {"div.woocommerce-product-details__short-description", "div.b", "div.txt", "div.desc", "div.post-body"}
_AMOUNT = re.compile(r"[$€£₿¢]|\b(?:USD|EUR|CHF|GBP|CAD|AUD|BTC|XMR|sats?|satoshi|dollars|euro|francs|cents|monero|bitcoin|sterling|mBTC|milli-BTC)\b", re.I)
_SLOT = re.compile(r"[{\[%]|NaN|TBD")


def _shape(text: str) -> str:
    return re.sub(r"[0-9a-f]*\d[0-9a-f]*", "9", text.strip())


def notices(pages: list[tuple[list[str], list[tuple[str, ...]]]]) -> set[str]:
    """Texts of bare pages, those of at most four leaves."""
    return {_shape(t) for ts, _ in pages if 0 < len(ts) <= 4 for t in ts if _shape(t) != "9"}


def weak_roles(texts: list[str], paths: list[tuple[str, ...]], known: set[str]) -> list[int]:
    out = [M.FURNITURE] * len(texts)
    price_next = False
    for i, (text, path) in enumerate(zip(texts, paths)):
        names = {p.split(".")[0].split(">")[0] for p in path}
        if names & {"nav", "footer", "aside", "button", "header"} or any(".dialog" in p or p.endswith(".crumb") for p in path) or {"div.lft", "div.post-meta"} & set(path) or path and path[-1].startswith("a>#"):
            continue
        if any(p.startswith("h1") for p in path) or _TITLE & set(path) or "center" in path and "h5" in path:
            out[i] = M.TITLE
        elif "div.summary" in path or "p.price" in path:
            out[i] = M.PRICE
        elif "table" in path and "td" in path:
            out[i] = M.PRICE if price_next else M.FACT
            price_next = text.strip().lower() in PRICE_LABELS
        elif _BODY & set(path):
            out[i] = M.TEXT
        elif "div.reviews" in path or "section" in path or "div.comment" in path and "div" in path[path.index("div.comment") + 1 :]:
            out[i] = M.REPLY
    if M.TITLE not in out or len(texts) <= 6:
        for i, text in enumerate(texts):
            if _shape(text) in known:
                out[i] = M.TEXT
    heads = [i for i in range(len(texts)) if out[i] == M.TITLE and any(p.startswith("h1.~") for p in paths[i])]
    if heads:  # classes tell nothing: blocks after the title, up to the list of other items
        block = [j for j in range(heads[-1] + 1, len(texts)) if out[j] == M.FURNITURE and "div.cnt" in paths[j] and paths[j][paths[j].index("div.cnt") + 1 :][:1] == ("div.~",) and not paths[j][-1].startswith(("a>#", "button"))]
        items = [n for n, j in enumerate(block) if any(p.startswith("a>/item") for p in paths[j])]
        if items:
            block = block[: max(0, items[0] - 1)]
        for j in block:
            first = j == heads[-1] + 1 and len(texts[j]) < 60 and (_AMOUNT.search(texts[j]) or _SLOT.search(texts[j]) or re.fullmatch(r"\s*[\d.,]+\s*|N/A|Sold out|on request|price in chat|contact vendor", texts[j]))
            out[j] = M.PRICE if first else M.TEXT
    return out


def step(net: M.Labeller, pages: list, roles: np.ndarray, m: dict, v: dict, t: int, rate: float) -> float:
    """One Adam step on a batch; gradients by hand through both directions."""
    p = net.p
    b = net.inputs(pages)
    x, mask, row, col = b["x"], b["mask"], b["row"], b["col"]
    hf, sf = net.run(x, mask, "f", True)
    hb, sb = net.run(x, mask, "b", True)
    h = np.concatenate([hf[col, row], hb[col, row]], axis=1)
    z = h @ p["out"] + p["outb"]
    z -= z.max(1, keepdims=True)
    e = np.exp(z)
    prob = e / e.sum(1, keepdims=True)
    n = len(roles)
    loss = -np.log(prob[np.arange(n), roles] + 1e-9).mean()
    dz = prob
    dz[np.arange(n), roles] -= 1
    dz /= n
    grad = {"out": h.T @ dz, "outb": dz.sum(0)}
    dh = dz @ p["out"].T
    dx = np.zeros_like(x)
    H = M.HIDDEN
    for d, saved, part in (("f", sf, dh[:, :H]), ("b", sb, dh[:, H:])):
        dhs = np.zeros((*x.shape[:2], H), np.float32)
        dhs[col, row] = part
        U, W = p["u" + d], p["w" + d]
        dU = np.zeros_like(U)
        da_all = np.zeros((*x.shape[:2], 4 * H), np.float32)
        dhn, dcn = np.zeros((x.shape[1], H), np.float32), np.zeros((x.shape[1], H), np.float32)
        for s, i, f, o, g, c, hp, tc, mk in reversed(saved):
            dht = dhn + dhs[s]
            live = np.where(mk, dht, 0)
            dct = np.where(mk, dcn, 0) + live * o * (1 - tc**2)
            da = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), live * tc * o * (1 - o), dct * i * (1 - g**2)], axis=1)
            da_all[s] = da
            dU += hp.T @ da
            dhn = np.where(mk, da @ U.T, dht)
            dcn = np.where(mk, dct * f, dcn)
        flat = da_all.reshape(-1, 4 * H)
        grad["w" + d], grad["u" + d], grad["c" + d] = x.reshape(-1, M.INPUT).T @ flat, dU, flat.sum(0)
        dx += (flat @ W.T).reshape(x.shape)
    dl = dx[col, row]
    dpath = np.zeros((len(b["pl"]), M.PATH_DIM), np.float32)
    np.add.at(dpath, b["which"], dl[:, : M.PATH_DIM])
    for name, ids, lens, part in (("path", b["pflat"], b["pl"], dpath), ("word", b["wflat"], b["wl"], dl[:, M.PATH_DIM : M.PATH_DIM + M.WORD_DIM] / np.sqrt(b["wl"])[:, None])):
        gsum = np.zeros_like(p[name])
        np.add.at(gsum, ids, np.repeat(part, lens, axis=0))
        grad[name] = gsum
    norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
    for k, g in grad.items():
        g = g * min(1, 5 / (norm + 1e-9))
        m[k] = 0.9 * m[k] + 0.1 * g
        v[k] = 0.99 * v[k] + 0.01 * g**2
        p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    return float(loss)


def train(pages: list, roles: list[np.ndarray], epochs: int = EPOCHS, seed: int = 0) -> M.Labeller:
    net = M.Labeller.fresh(seed)
    m = {k: np.zeros_like(a) for k, a in net.p.items()}
    v = {k: np.zeros_like(a) for k, a in net.p.items()}
    r = np.random.default_rng(seed)
    t = 0
    order = np.argsort([len(x) for x, _ in pages], kind="stable")
    groups = [order[s : s + PAGES_A_STEP] for s in range(0, len(order), PAGES_A_STEP)]
    for epoch in range(epochs):
        total = 0.0
        for g in r.permutation(len(groups)):
            t += 1
            ids = groups[g]
            total += step(net, [pages[n] for n in ids], np.concatenate([roles[n] for n in ids]), m, v, t, 0.006 * (1 - epoch / epochs) + 0.0004)
        print(f"epoch {epoch} loss {total / len(groups):.5f}", flush=True)
    return net


def evaluate(net: M.Labeller, pages: list, roles: list[np.ndarray]) -> tuple[float, float, float, float]:
    """(precision, recall of main leaves, share of right roles, share of pages without an error)."""
    got = net.roles(pages)
    a, b = np.concatenate(got), np.concatenate(roles)
    tp = ((a > 0) & (b > 0)).sum()
    return tp / max(1, (a > 0).sum()), tp / max(1, (b > 0).sum()), float((a == b).mean()), float(np.mean([((x > 0) == (y > 0)).all() for x, y in zip(got, roles)]))


def prepare(table: str) -> tuple[list, list, list[str]]:
    import pyarrow.dataset as ds

    t = ds.dataset(table).to_table(columns=["market", "product_url", "html"]).to_pydict()
    rows = [(m or "", u or "", h) for m, u, h in zip(t["market"], t["product_url"], t["html"]) if h and h.strip()]
    rows.sort(key=lambda r: zlib.crc32((r[1] + r[2][:200]).encode()))
    pages, sites = [], []
    for m, u, h in rows[: 2 * MAX_PAGES]:
        q = leaves(h)
        if q[0]:
            pages.append(q)
            sites.append(re.sub(r"^https?://", "", u.strip().lower()).split("/")[0] or m)
    known = notices(pages)
    return pages, [np.array(weak_roles(*q, known)) for q in pages], sites


def main(table: str, out: str, check: str | None = None) -> None:
    pages, roles, sites = prepare(table)
    if HOLD_OUT:
        hold_out(pages, roles, sites)
    net = train(pages[:MAX_PAGES], roles[:MAX_PAGES])
    if check:
        cp, cr, _ = prepare(check)
        print("other table", evaluate(net, cp, cr))
    np.savez_compressed(out, **{k: a.astype(np.float16) for k, a in net.p.items()})


def hold_out(pages: list, roles: list, sites: list[str]) -> None:
    """Prints the accuracy on sites that training didn't see."""
    held = [n for n, s in enumerate(sites) if zlib.crc32(s.encode()) % 5 == 0]
    rest = [n for n in range(len(pages)) if zlib.crc32(sites[n].encode()) % 5][:MAX_PAGES]
    net = train([pages[n] for n in rest], [roles[n] for n in rest])
    print("held-out sites", evaluate(net, [pages[n] for n in held], [roles[n] for n in held]))


if __name__ == "__main__":
    main(*sys.argv[1:])
