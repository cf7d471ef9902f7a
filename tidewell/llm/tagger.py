"""A character-level bidirectional LSTM with CRF transitions, in numpy, and the labelled spans that it learns from."""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + 2 * len(KINDS)  # 0 outside; 1 + 2k begins kind k, 2 + 2k goes on
WINDOW = 96
#: Moves that the labels don't allow: into the middle of a kind that hasn't begun.
BARRED = np.array([[to > 0 and to % 2 == 0 and was not in (to, to - 1) for to in range(LABELS)] for was in range(LABELS)])


def codes(points: np.ndarray) -> np.ndarray:
    """Characters as small numbers: ASCII by itself, other letters and signs in two classes, 0 for padding."""
    return np.where(points == 0, 0, np.where(points < 128, points, np.where(points < 0x2000, 128, 129))).astype(np.int64)


CODES = 130


def luhn(digits: str) -> str:
    total = sum(sum(divmod(int(d) * (2 - k % 2), 10)) for k, d in enumerate(reversed(digits)))
    return str(-total % 10)


def sample(draw: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A window of invented prose with labelled spans, and with numbers and names that are none."""
    letters = "etaoinshrdlucmfwygpbvketaoinsjqxz"
    word = lambda: "".join(draw.choice(letters) for _ in range(draw.randint(1, 9)))
    digits = lambda n: "".join(draw.choice("0123456789") for _ in range(n))

    def email():
        name = draw.choice([word(), f"{word()}.{word()}", f"{word()}.{word()}", f"{word()}{digits(2)}", f"{word()}_{word()}", f"{word()}-{word()}", f"{draw.choice(letters)}.{word()}"])
        at = draw.choice(["@"] * 3 + [" @ ", "@ ", "(at)", " (at) ", " (at) ", "[at]", " [at] ", " (AT) ", "[AT]", " at ", " at "])
        dot = " dot " if at == " at " else draw.choice([".", ".", " . ", "(dot)", " (dot) ", " [dot] ", " (DOT) "]) if at != "@" else "."
        host = draw.choice([word(), word(), f"{word()}-{word()}"])
        return name + at + dot.join([host, *([draw.choice(["co", "ac", word()])] if draw.random() < 0.3 else []), draw.choice(["com", "org", "net", "de", "fr", "es", "io", "edu", "co", "uk", "se", "it"])])

    def ip():
        if draw.random() < 0.3:
            size = draw.choice([draw.randint(1, 4), 4, None, None])
            return ":".join("".join(draw.choice("0123456789abcdef") for _ in range(size or draw.randint(1, 4))) for _ in range(8))
        part = lambda: str(draw.choice([draw.randint(0, 9), draw.randint(10, 99), draw.randint(100, 255)]))
        return draw.choice([".", " . ", " . ", " .", ". "]).join(part() for _ in range(4))

    def card():
        body = draw.choice("3456") + digits(14)
        body += luhn(body)
        return draw.choice(["", " ", "-", ".", "/"]).join(body[k : k + 4] for k in range(0, 16, 4))

    def grouped():
        """A code, in brackets or not, and two to five groups of digits."""
        code = draw.choice([f"({draw.choice(['0', ''])}{digits(draw.randint(2, 4))})", f"0{digits(draw.randint(1, 4))}", f"00{digits(2)}", f"{digits(draw.randint(2, 3))}", f"+{digits(draw.randint(1, 2))}"])
        between = draw.choice([" ", " ", "-", ".", " "])
        out = code + draw.choice([" ", between, "/", " / ", "-"]) + between.join(digits(draw.randint(2, 5)) for _ in range(draw.randint(1, 5)))
        return out if 9 <= sum(c.isdigit() for c in out) <= 13 else grouped()

    def phone():
        if draw.random() < 0.5:
            return grouped()
        area, a, b = digits(3), digits(3), digits(4)
        town = f"0{digits(draw.randint(2, 4))}"
        return draw.choice([f"{town}/{digits(draw.randint(5, 7))}", f"{town}-{digits(draw.randint(4, 6))}-{digits(2)}", f"{town} {a} {b}", f"{area}.{a}.{digits(3)}", f"(0){digits(2)}-{digits(4)}-{digits(4)}", f"{town} / {a} {digits(3)}", f"+1 ({area}) {a}-{b}", f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"+{digits(2)} {digits(3)} {digits(3)} {digits(3)}", f"{area}.{a}.{b}", f"+{digits(11)}", f"00{digits(2)} {digits(3)} {digits(6)}", f"0{digits(2)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}"])

    def other():
        return draw.choice(
            [
                lambda: str(draw.randint(1900, 2030)), lambda: f"{draw.randint(1, 28)}.{draw.randint(1, 12)}.{draw.randint(1990, 2025)}", lambda: f"2{digits(3)}-0{draw.randint(1, 9)}-1{digits(1)}",
                lambda: f"${digits(draw.randint(1, 4))}.{digits(2)}", lambda: f"{digits(2)}:{digits(2)}", lambda: "".join(draw.choice("0123456789abcdef") for _ in range(draw.choice([8, 16, 32, 40]))),
                lambda: digits(draw.choice([1, 2, 3, 4, 5, 6, 8])), lambda: f"v{digits(1)}.{digits(1)}.{digits(2)}", lambda: f"{digits(1)}.{digits(2)}%", lambda: f"@{word()}", lambda: f"CC BY-NC 4.{digits(1)}",
                lambda: f"{digits(3)},{digits(3)},{digits(3)}", lambda: f"{word()} at {word()} {word()}", lambda: f"at {word()}", lambda: f"{word()} dot {word()}", lambda: f"#{digits(7)}", lambda: f"ISBN {digits(3)}-{digits(1)}-{digits(5)}-{digits(3)}-{digits(1)}",
            ]
        )()

    text, spans = "", []
    skip = draw.randint(0, 12)
    while len(text) < WINDOW + skip:
        turn = draw.random()
        if turn < 0.13:
            kind = draw.randrange(4)
            what = (email, ip, card, phone)[kind]()
            spans.append((kind, len(text), len(text) + len(what)))
            text += what
        elif turn < 0.24:
            text += other()
        else:
            text += word().capitalize() if draw.random() < 0.15 else word()
        text += draw.choice([" "] * 12 + [", ", ". ", "\n", "; ", ": ", " - ", ".\n"])
    return text[skip : skip + WINDOW], [(k, a - skip, b - skip) for k, a, b in spans if a >= skip and b <= skip + WINDOW] + [(k, max(a - skip, 0), min(b - skip, WINDOW)) for k, a, b in spans if (a < skip < b) or (a < skip + WINDOW < b)]


def labelled(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(characters, labels) of n windows."""
    draw = random.Random(seed)
    x, y = np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), np.int64)
    for row in range(n):
        text, spans = sample(draw)
        if draw.random() < 0.3:  # the end of a text
            end = draw.randint(15, WINDOW - 1)
            text, spans = text[:end], [(k, a, b) for k, a, b in spans if b <= end]
        x[row, : len(text)] = codes(np.array([*map(ord, text)]))
        for kind, a, b in spans:
            y[row, a:b] = 2 + 2 * kind
            y[row, a] = 1 + 2 * kind if a > 0 or len(text) else 0
    return x, y


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    def __init__(self, embed: int = 16, hidden: int = 28, seed: int = 1):
        draw = np.random.default_rng(seed)
        near = lambda *shape: draw.normal(0, shape[0] ** -0.5, shape)
        self.p = {"e": draw.normal(0, 0.3, (CODES, embed)), "o": near(2 * hidden, LABELS), "ob": np.zeros(LABELS), "t": np.zeros((LABELS, LABELS)), "s": np.zeros(LABELS)}
        for way in "fb":
            self.p |= {way + "x": near(embed, 4 * hidden), way + "h": near(hidden, 4 * hidden), way + "c": np.repeat([0.0, 1.0, 0.0, 0.0], hidden)}
        self.hidden = hidden

    def run(self, x: np.ndarray, keep: bool = False):
        """x: windows by characters. Emissions (time, window, label); with keep also what backward() needs."""
        p, n = self.p, self.hidden
        e = p["e"][x.T]
        tape = {}
        out = []
        for way in "fb":
            pre = e @ p[way + "x"] + p[way + "c"]
            h, c = np.zeros((x.shape[0], n)), np.zeros((x.shape[0], n))
            steps = range(len(pre)) if way == "f" else range(len(pre) - 1, -1, -1)
            hs = np.zeros((len(pre), x.shape[0], n))
            own = [None] * len(pre)
            for t in steps:
                z = pre[t] + h @ p[way + "h"]
                gates, g = sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
                c_new = gates[:, n : 2 * n] * c + gates[:, :n] * g
                tanh = np.tanh(c_new)
                h_new = gates[:, 2 * n :] * tanh
                if keep:
                    own[t] = (h, c, gates, g, tanh)
                h, c, hs[t] = h_new, c_new, h_new
            tape[way] = own
            out.append(hs)
        both = np.concatenate(out, 2)
        return (both @ p["o"] + p["ob"], (e, both, tape)) if keep else both @ p["o"] + p["ob"]

    def backward(self, x: np.ndarray, d: np.ndarray, kept) -> dict:
        p, n = self.p, self.hidden
        e, both, tape = kept
        g = {"o": np.einsum("tbi,tbk->ik", both, d), "ob": d.sum((0, 1))}
        d_both = d @ p["o"].T
        d_e = np.zeros_like(e)
        for k, way in enumerate("fb"):
            wx, wh = p[way + "x"], p[way + "h"]
            dh, dc = np.zeros((x.shape[0], n)), np.zeros((x.shape[0], n))
            dz_all = np.zeros((len(e), x.shape[0], 4 * n))
            gh = np.zeros_like(wh)
            for t in range(len(e) - 1, -1, -1) if way == "f" else range(len(e)):
                h, c, gates, cell, tanh = tape[way][t]
                dh = dh + d_both[t, :, k * n : (k + 1) * n]
                i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
                dc = dc + dh * o * (1 - tanh**2)
                dz = dz_all[t]
                dz[:, :n], dz[:, n : 2 * n], dz[:, 2 * n : 3 * n], dz[:, 3 * n :] = dc * cell * i * (1 - i), dc * c * f * (1 - f), dh * tanh * o * (1 - o), dc * i * (1 - cell**2)
                gh += h.T @ dz
                dh, dc = dz @ wh.T, dc * f
            g |= {way + "h": gh, way + "x": np.einsum("tbi,tbk->ik", e, dz_all), way + "c": dz_all.sum((0, 1))}
            d_e += dz_all @ wx.T
        g["e"] = np.zeros_like(p["e"])
        np.add.at(g["e"], x.T, d_e)
        return g

    def crf(self, emit: np.ndarray, y: np.ndarray):
        """Mean log-loss of the label paths y (window, time), and its gradients by emissions, transitions and starts."""
        moves = self.p["t"] + np.where(BARRED, -1e4, 0)
        steps, rows = emit.shape[0], emit.shape[1]

        def total(v, axis):
            top = v.max(axis, keepdims=True)
            return np.squeeze(top, axis) + np.log(np.exp(v - top).sum(axis))

        ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
        ahead[0] = self.p["s"] + emit[0]
        for t in range(1, steps):
            ahead[t] = emit[t] + total(ahead[t - 1][:, :, None] + moves, 1)
        for t in range(steps - 2, -1, -1):
            behind[t] = total(moves + (emit[t + 1] + behind[t + 1])[:, None, :], 2)
        z = total(ahead[-1], 1)
        d = np.exp(ahead + behind - z[None, :, None])
        pair = np.exp(ahead[:-1, :, :, None] + moves + (emit[1:] + behind[1:])[:, :, None, :] - z[None, :, None, None]).sum((0, 1))
        t, b = np.meshgrid(np.arange(steps), np.arange(rows), indexing="ij")
        path = emit[t, b, y.T].sum(0) + moves[y[:, :-1], y[:, 1:]].sum(1) + self.p["s"][y[:, 0]]
        d[t, b, y.T] -= 1
        np.add.at(pair, (y[:, :-1], y[:, 1:]), -1)
        start = d[0].sum(0)
        return (z - path).mean(), d / rows, pair / rows, start / rows

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 9, batch: int = 64, rate: float = 0.012, seed: int = 2) -> float:
        draw = np.random.default_rng(seed)
        first, second = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}
        turn, loss = 0, 0.0
        for epoch in range(rounds):
            order, losses = draw.permutation(len(x)), []
            for at in range(0, len(x), batch):
                own = order[at : at + batch]
                emit, kept = self.run(x[own], keep=True)
                loss, d, pair, start = self.crf(emit, y[own])
                g = self.backward(x[own], d, kept) | {"t": pair, "s": start}
                norm = np.sqrt(sum((v * v).sum() for v in g.values()))
                turn += 1
                for k, v in self.p.items():
                    own_g = g[k] / max(1.0, norm / 5)
                    first[k] += 0.1 * (own_g - first[k])
                    second[k] += 0.01 * (own_g**2 - second[k])
                    v -= rate * (0.3 if epoch >= rounds * 2 // 3 else 1) * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.99**turn)) + 1e-8)
                losses.append(loss)
            loss = float(np.mean(losses))
        return loss

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(best labels, how far the label's emission is above "outside") by window and time."""
        emit = self.run(x)
        moves = self.p["t"] + np.where(BARRED, -1e4, 0)
        score, back = self.p["s"] + emit[0], []
        for t in range(1, len(emit)):
            every = score[:, :, None] + moves
            back.append(every.argmax(1))
            score = every.max(1) + emit[t]
        path = [score.argmax(1)]
        for b in reversed(back):
            path.append(b[np.arange(len(x)), path[-1]])
        y = np.stack(path[::-1], 1)
        t, b = np.meshgrid(np.arange(len(emit)), np.arange(len(x)), indexing="ij")
        return y, (emit[t, b, y.T] - emit[:, :, 0]).T


@lru_cache(2)
def trained(samples: int = 5400, seed: int = 7) -> Tagger:
    """The model of this many labelled windows; the same each time."""
    out = Tagger()
    out.fit(*labelled(samples, seed))
    return out
