"""Numpy kernels that run inside Spark tasks on one frame or one trajectory; no Spark in here."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


#: Numbers that are blurred, or searched for blobs, at once: what a core keeps near.
CELLS = 1 << 16


def gaussian_blur(frame: np.ndarray, sigma: float) -> np.ndarray:
    """Separable blur over the first two axes, cut at four sigma, with mirrored borders; a third axis holds frames, each blurred alone.

    A pixel's sum is added up in the same order wherever it lies.
    """
    if sigma <= 0:
        return frame.astype(float)
    radius = int(4 * sigma + 0.5)
    taps = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    taps /= taps.sum()
    out = frame.astype(float)
    for axis in (0, 1):
        n, source, out = out.shape[axis], out, np.empty_like(out)
        at = np.arange(-radius, n + radius) % (2 * n)
        at = np.where(at < n, at, 2 * n - 1 - at)
        step = max(1, CELLS * source.shape[1 - axis] // max(1, source.size))
        for k in range(0, source.shape[1 - axis], step):
            cut = (slice(None), slice(k, k + step)) if axis == 0 else (slice(k, k + step),)
            wide = np.take(source[cut], at, axis=axis)
            moved = lambda j, wide=wide, axis=axis, n=n: wide[j : j + n] if axis == 0 else wide[:, j : j + n]
            total = taps[radius] * moved(radius)
            for j in range(radius):
                total += taps[j] * (moved(j) + moved(2 * radius - j))
            out[cut] = total
    return out


def hann_disc(shape: tuple[int, int]) -> np.ndarray:
    """A Hann window that falls off with the distance from the middle."""
    y, x = np.ogrid[: shape[0], : shape[1]]
    r = np.hypot((y - shape[0] / 2) / (shape[0] / 2), (x - shape[1] / 2) / (shape[1] / 2))
    return np.where(r <= 1, 0.5 * (1 + np.cos(np.pi * r)), 0.0)


def shift_between(frame: np.ndarray, reference: np.ndarray, window: np.ndarray | None = None) -> tuple[int, int]:
    """Rows and columns by which ``frame`` lies beyond ``reference``: the peak of their circular cross-correlation."""
    spectrum = np.conj(np.fft.fft2(reference)) * np.fft.fft2(frame)
    if window is not None:
        spectrum = spectrum * np.fft.ifftshift(window)
    peak = np.unravel_index(np.argmax(np.fft.ifft2(spectrum).real), frame.shape)
    return tuple(int(p - n if p > n // 2 else p) for p, n in zip(peak, frame.shape, strict=True))


def shifted(frame: np.ndarray, dr: int, dc: int) -> np.ndarray:
    """out[r, c] = frame[r + dr, c + dc], 0 beyond the border."""
    out = np.zeros_like(frame)
    h, w = frame.shape
    if abs(dr) < h and abs(dc) < w:
        out[max(0, -dr) : h - max(0, dr), max(0, -dc) : w - max(0, dc)] = frame[max(0, dr) : h - max(0, -dr), max(0, dc) : w - max(0, -dc)]
    return out


def _largest_around(cube: np.ndarray) -> np.ndarray:
    """The largest value among each one's neighbours in the first three dimensions, itself included."""
    for axis in range(3):
        own = np.moveaxis(cube, axis, 0)
        cube = cube.copy()
        most = np.moveaxis(cube, axis, 0)
        np.maximum(most[1:], own[:-1], out=most[1:])
        np.maximum(most[:-1], own[1:], out=most[:-1])
    return cube


def _log_maxima(frames: np.ndarray, sigmas: np.ndarray, threshold: float, rows: tuple[int, int], columns: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blobs (row, column, sigma), their strengths and frames within some rows and columns, from no more of the frames than these depend on."""
    halo = int(4 * sigmas.max() + 0.5) + 2
    r0, c0 = max(0, rows[0] - halo), max(0, columns[0] - halo)
    part = frames[r0 : rows[1] + halo, c0 : columns[1] + halo]
    cube = []
    for s in sigmas:
        g = np.pad(gaussian_blur(part, s), ((1, 1), (1, 1), (0, 0)), mode="symmetric")
        cube.append(-(s**2) * (g[2:, 1:-1] + g[:-2, 1:-1] + g[1:-1, 2:] + g[1:-1, :-2] - 4 * g[1:-1, 1:-1]))
    cube = np.stack(cube)
    s, r, c, f = np.nonzero((cube == _largest_around(cube)) & (cube > threshold))
    r, c, strength = r + r0, c + c0, cube[s, r, c, f]
    own = (r >= rows[0]) & (r < rows[1]) & (c >= columns[0]) & (c < columns[1])
    return np.column_stack([r, c, sigmas[s]])[own], strength[own], f[own]


def log_blobs(frame: np.ndarray, **how) -> np.ndarray:
    """``log_blobs_each`` of one frame."""
    return log_blobs_each(frame[:, :, None], **how)[0]


def log_blobs_each(frames: np.ndarray, min_sigma: float = 1, max_sigma: float = 50, num_sigma: int = 10, threshold: float = 0.2, overlap: float = 0.5, tile: int = 512) -> list[np.ndarray]:
    """Bright blobs (row, column, sigma) of each frame of a stack (rows, columns, frames): maxima over place and scale of the scaled negative Laplacian of Gaussian.

    Frames are looked at by tiles with a halo that the widest blur reaches over, so that memory is a tile's and borders of
    tiles change nothing. Of two blobs that overlap by more than ``overlap`` the smaller one goes (equal: the weaker), from
    the strongest blob on; only those near enough to overlap are compared.
    """
    sigmas = np.linspace(min_sigma, max_sigma, num_sigma)
    high, wide, many = frames.shape
    parts = [_log_maxima(frames, sigmas, threshold, (r, min(r + tile, high)), (c, min(c + tile, wide))) for r in range(0, high, tile) for c in range(0, wide, tile)]
    blobs, strength, of = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.lexsort((blobs[:, 1], blobs[:, 0], np.searchsorted(sigmas, blobs[:, 2]), -strength, of))
    blobs, last = blobs[order], np.cumsum(np.bincount(of, minlength=many))
    return [_apart(b, overlap) for b in np.split(blobs, last[:-1])]


def _apart(blobs: np.ndarray, overlap: float) -> np.ndarray:
    """Those of a frame's blobs, the strongest first, that stay."""
    keep = np.ones(len(blobs), bool)
    i, j = near_blobs(blobs)
    over = overlaps(blobs[i], blobs[j]) > overlap
    i, j = i[over], j[over]
    for a, b in zip(*(v[np.lexsort((j, i))].tolist() for v in (i, j)), strict=True):
        if keep[a] and keep[b]:
            keep[a if blobs[a, 2] < blobs[b, 2] else b] = False
    return blobs[keep]


#: Blobs of a frame whose pairs are all tried.
FEW_BLOBS = 256


def near_blobs(blobs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (first, later) of blobs whose discs of radius sigma * sqrt(2) touch: of few blobs all pairs are tried, of more those in cells as wide as two sizes' discs reach together."""
    if len(blobs) <= FEW_BLOBS:
        i, j = np.triu_indices(len(blobs), 1)
        apart = blobs[i] - blobs[j]
        near = (apart[:, :2] ** 2).sum(axis=1) < ((blobs[i, 2] + blobs[j, 2]) * 2**0.5) ** 2
        return i[near], j[near]
    found = [np.zeros((2, 0), int)]
    sizes = np.unique(blobs[:, 2])
    of = [np.flatnonzero(blobs[:, 2] == s) for s in sizes]
    for p, s in enumerate(sizes):
        for q in range(p, len(sizes)):
            reach = (s + sizes[q]) * 2**0.5
            a, b = (np.floor(blobs[g, :2] / reach).astype(np.int64) for g in (of[p], of[q]))
            width = int(max(a[:, 1].max(), b[:, 1].max())) + 3
            cell = np.sort((b[:, 0] + 1) * width + b[:, 1] + 1)
            order = np.argsort((b[:, 0] + 1) * width + b[:, 1] + 1, kind="stable")
            for dr in (-1, 0, 1):  # three cells of a row are neighbours in the order
                low = (a[:, 0] + 1 + dr) * width + a[:, 1]
                first, last = np.searchsorted(cell, low, "left"), np.searchsorted(cell, low + 2, "right")
                n = last - first
                i = np.repeat(of[p], n)
                j = of[q][order[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]]
                near = (i != j) & (((blobs[i, :2] - blobs[j, :2]) ** 2).sum(axis=1) < reach**2)
                found.append(np.stack([np.minimum(i, j)[near], np.maximum(i, j)[near]]))
    pairs = np.unique(np.concatenate(found, axis=1), axis=1)
    return pairs[0], pairs[1]


def box_sums(image: np.ndarray, rows: np.ndarray, columns: np.ndarray, inner: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the squares of 2 inner + 1 and 2 reach + 1 pixels about some places; what lies beyond the border adds nothing."""
    high, wide = image.shape
    pad = np.zeros((high + 4 * reach, wide + 4 * reach))
    pad[2 * reach : 2 * reach + high, 2 * reach : 2 * reach + wide] = image
    o = np.arange(-reach, reach + 1)
    r, c = (np.clip(v, -reach, n + reach - 1) + 2 * reach for v, n in ((rows, high), (columns, wide)))
    square = pad.ravel()[(r * pad.shape[1] + c)[:, None] + (o[:, None] * pad.shape[1] + o).ravel()]
    middle = ((np.abs(o) <= inner)[:, None] & (np.abs(o) <= inner)).ravel()
    return square[:, middle].sum(axis=1), square.sum(axis=1)


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs of blobs, the shared area of their discs of radius sigma * sqrt(2) over the smaller disc's."""
    ra, rb = a[:, 2] * 2**0.5, b[:, 2] * 2**0.5
    d = np.hypot(a[:, 0] - b[:, 0], a[:, 1] - b[:, 1])
    within = d <= np.abs(ra - rb)
    safe = np.where(within | (d == 0), 1.0, d)
    alpha = np.arccos(np.clip((safe**2 + ra * ra - rb * rb) / (2 * safe * ra), -1, 1))
    beta = np.arccos(np.clip((safe**2 + rb * rb - ra * ra) / (2 * safe * rb), -1, 1))
    area = ra * ra * (alpha - np.sin(2 * alpha) / 2) + rb * rb * (beta - np.sin(2 * beta) / 2)
    return np.where(d >= ra + rb, 0.0, np.where(within, 1.0, area / (np.pi * np.minimum(ra, rb) ** 2)))


def least_squares(f: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int = 200, tolerance: float = 1e-8) -> tuple[np.ndarray, bool]:
    """Levenberg-Marquardt on residuals ``f``, with a numeric Jacobian; the parameters, and whether it settled."""
    p, damping = np.array(start, float), 1e-3
    r = f(p)
    for _ in range(steps):
        h = 1e-6 * np.maximum(np.abs(p), 1e-3)
        jac = np.stack([(f(p + np.eye(len(p))[k] * h[k]) - r) / h[k] for k in range(len(p))], axis=1)
        a, g = jac.T @ jac, jac.T @ r
        for _ in range(20):
            try:
                move = np.linalg.solve(a + damping * np.diag(np.maximum(np.diag(a), 1e-12)), -g)
            except np.linalg.LinAlgError:
                damping *= 10
                continue
            new = f(p + move)
            if np.isfinite(new).all() and new @ new < r @ r:
                gain, p, r, damping = (r @ r - new @ new) / max(r @ r, 1e-300), p + move, new, damping / 5
                break
            damping *= 10
        else:
            return p, True
        if gain < tolerance or np.linalg.norm(move) < tolerance * (np.linalg.norm(p) + tolerance):
            return p, True
    return p, False


def gaussian_2d(x: np.ndarray, y: np.ndarray, p: np.ndarray) -> np.ndarray:
    """A rotated Gaussian at places; parameters along the last axis, for one or for many."""
    amplitude, xo, yo, sx, sy, theta, offset = (v[..., None] for v in np.moveaxis(p, -1, 0)) if p.ndim > 1 else p
    c, s = np.cos(theta), np.sin(theta)
    u, v = x - xo, y - yo
    a, b, d = c * c / (2 * sx * sx) + s * s / (2 * sy * sy), np.sin(2 * theta) * (1 / (4 * sy * sy) - 1 / (4 * sx * sx)), s * s / (2 * sx * sx) + c * c / (2 * sy * sy)
    return offset + amplitude * np.exp(-(a * u * u + 2 * b * u * v + d * v * v))


def least_squares_each(f: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, steps: int = 200, tolerance: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """``least_squares`` of many problems that step together, each by its own damping until it settles: f(parameters, numbers of the problems)."""
    p, damping, settled = np.array(start, float), np.full(len(start), 1e-3), np.zeros(len(start), bool)
    open_ = np.arange(len(p))
    r = f(p, open_)
    eye = np.eye(p.shape[1])
    with np.errstate(all="ignore"):
        for _ in range(steps):
            if not len(open_):
                break
            now, own = p[open_], r[open_]
            h = 1e-6 * np.maximum(np.abs(now), 1e-3)
            jac = np.stack([(f(now + eye[k] * h[:, k : k + 1], open_) - own) / h[:, k : k + 1] for k in range(p.shape[1])], axis=2)
            a, g, cost = jac.transpose(0, 2, 1) @ jac, np.einsum("nmk,nm->nk", jac, own), (own * own).sum(axis=1)
            diagonal = np.maximum(np.einsum("nkk->nk", a), 1e-12)
            gain, move, left = np.zeros(len(open_)), np.zeros_like(now), np.arange(len(open_))
            for _ in range(20):
                damped = a[left] + damping[open_[left], None, None] * diagonal[left, :, None] * eye
                step, solved = _solved(damped, -g[left])
                new = f(now[left] + step, open_[left])
                after = (new * new).sum(axis=1)
                better = solved & np.isfinite(new).all(axis=1) & (after < cost[left])
                took, which = left[better], open_[left[better]]
                gain[took], move[took] = (cost[took] - after[better]) / np.maximum(cost[took], 1e-300), step[better]
                p[which], r[which] = now[took] + step[better], new[better]
                damping[which] /= 5
                left = left[~better]
                damping[open_[left]] *= 10
                if not len(left):
                    break
            done = (gain < tolerance) | (np.linalg.norm(move, axis=1) < tolerance * (np.linalg.norm(p[open_], axis=1) + tolerance))
            settled[open_[done]] = True
            open_ = open_[~done]
    return p, settled


def _solved(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions of many systems, and which have one."""
    try:
        return np.linalg.solve(a, b[..., None])[..., 0], np.ones(len(a), bool)
    except np.linalg.LinAlgError:
        out, ok = np.zeros_like(b), np.zeros(len(a), bool)
        for k in range(len(a)):
            try:
                out[k], ok[k] = np.linalg.solve(a[k], b[k]), True
            except np.linalg.LinAlgError:
                continue
        return out, ok


def patches(frame: np.ndarray, rows: np.ndarray, columns: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of 2 * radius pixels about places, and which places have a whole one."""
    whole = (rows >= radius) & (columns >= radius) & (rows + radius <= frame.shape[0]) & (columns + radius <= frame.shape[1])
    at = np.arange(-radius, radius)
    r, c = rows[whole], columns[whole]
    return frame[r[:, None, None] + at[:, None], c[:, None, None] + at], whole


def fit_patches(windows: np.ndarray, rows: np.ndarray, columns: np.ndarray, guess: tuple = (2, 2, 0, 0), legacy_grid: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A Gaussian fitted to each window about its place, all stepping together; parameters, and which fits settled on finite ones."""
    n, size = len(windows), windows.shape[1]
    radius = size // 2
    at = np.linspace(-radius, radius, size) if legacy_grid else np.arange(-radius, radius)
    one, two = np.repeat(at, size), np.tile(at, size)
    # x is the row, but with the legacy grid it runs along the columns, as numpy's default order of axes has it
    x, y = (rows[:, None] + (two if legacy_grid else one), columns[:, None] + (one if legacy_grid else two))
    data = windows.reshape(n, -1).astype(float)
    start = np.column_stack([data.max(axis=1), rows, columns, np.tile(np.asarray(guess, float), (n, 1))]) if n else np.zeros((0, 7))
    p, settled = least_squares_each(lambda q, which: gaussian_2d(x[which], y[which], q) - data[which], start)
    return p, settled & np.isfinite(p).all(axis=1)


def fit_spot(frame: np.ndarray, row: int, column: int, radius: int, guess: tuple = (2, 2, 0, 0), legacy_grid: bool = False) -> tuple[np.ndarray | None, str]:
    """A Gaussian fitted to the window of 2 * radius pixels about a peak; parameters and 'ok', 'clipped' or 'failed'."""
    windows, whole = patches(frame, np.array([row]), np.array([column]), radius)
    if not whole[0]:
        return None, "clipped"
    p, ok = fit_patches(windows, np.array([row]), np.array([column]), guess, legacy_grid)
    return (p[0], "ok") if ok[0] else (None, "failed")


def savgol_coefficients(width: int, polyorder: int) -> np.ndarray:
    """Weights of the rows of a window that give the fitted polynomial's value in its middle."""
    return savgol_edges(width, polyorder)[width // 2]


def savgol_edges(width: int, polyorder: int) -> np.ndarray:
    """Row k: the weights that give the fitted polynomial's value at row k of the window."""
    at = np.arange(width) - width // 2
    powers = np.vander(at, polyorder + 1, increasing=True).astype(float)
    return powers @ np.linalg.pinv(powers)


def log_normal(x: np.ndarray, means: np.ndarray, variances: np.ndarray) -> np.ndarray:
    return -0.5 * (np.log(2 * np.pi * variances) + (x[..., None] - means) ** 2 / variances)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    """The log of a sum of exponentials."""
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def padded(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences side by side (a row each, 0 beyond its end), and where they stand: row and column of each element."""
    sizes = np.diff(first)
    row = np.repeat(np.arange(len(sizes)), sizes)
    column = np.arange(len(x)) - np.repeat(first[:-1], sizes)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[row, column] = x
    return out, np.stack([row, column])


def by_length(first: np.ndarray, cells: int = 500_000) -> list[np.ndarray]:
    """Numbers of sequences of like lengths, so that those side by side have about ``cells`` places together."""
    sizes = np.diff(first)
    order, out, at = np.argsort(-sizes, kind="stable"), [], 0
    while at < len(order):
        n = max(1, cells // max(1, int(sizes[order[at]])))
        out.append(np.sort(order[at : at + n]))
        at += n
    return out


def _each(chosen: np.ndarray, start: np.ndarray, move: np.ndarray, means: np.ndarray, variances: np.ndarray) -> tuple[np.ndarray, ...]:
    """Parameters of some sequences, with an axis for them: one model for all, or one for each; log of starts and moves."""
    own = lambda p, dims: p[chosen] if p.ndim > dims else p[None]
    with np.errstate(divide="ignore"):
        ls, lm = np.log(own(np.asarray(start, float), 1)), np.log(own(np.asarray(move, float), 2))
    return ls, lm, own(np.asarray(means, float), 1)[:, None, :], own(np.asarray(variances, float), 1)[:, None, :]


def _entered(ls: np.ndarray, lm: np.ndarray, before: np.ndarray | None, joined: Callable[..., np.ndarray]) -> np.ndarray:
    """Of sequences, the log-weight of each state on entering: a start's, or what the row ``before`` moves on (NaN: there is none)."""
    if before is None:
        return ls
    return np.where(np.isnan(before[:, :1]), ls, joined(np.nan_to_num(before, nan=0.0, neginf=-np.inf)[:, :, None] + lm, 1))


def forward_backward(x: np.ndarray, first: np.ndarray, start: np.ndarray, move: np.ndarray, means: np.ndarray, variances: np.ndarray, before: np.ndarray | None = None, behind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sequences one after the other: the posterior of each state at each row, expected moves and log-likelihood of each sequence.

    Time is the only loop: sequences of like lengths take each step together. Parameters are one model's, or have a first
    axis with one for each sequence. A sequence can be a block of a longer one: ``before`` holds the forward sums at the row
    before it (NaN: it is the first), ``behind`` the backward sums at its last row; moves include the one into it.
    """
    k = np.shape(means)[-1]
    posterior, moves, totals = np.zeros((len(x), k)), np.zeros((len(first) - 1, k, k)), np.zeros(len(first) - 1)
    for chosen in by_length(first):
        sizes, rows, sub = _chosen(first, chosen)
        ls, lm, m, v2 = _each(chosen, start, move, means, variances)
        earlier = None if before is None else before[chosen]
        v, (row, column) = padded(x[rows], sub)
        b = log_normal(v, m, v2)
        f, r, last = np.empty_like(b), np.zeros_like(b), v.shape[1]
        if behind is not None:
            r[:] = behind[chosen][:, None, :]
        f[:, 0] = _entered(ls, lm, earlier, log_sum) + b[:, 0]
        for t in range(1, last):
            f[:, t] = log_sum(f[:, t - 1, :, None] + lm, 1) + b[:, t]
        for t in range(last - 2, -1, -1):
            step = log_sum(lm + (b[:, t + 1] + r[:, t + 1])[:, None, :], 2)
            r[:, t] = np.where((t + 1 < sizes)[:, None], step, r[:, t])
        ends = np.arange(len(sizes)), sizes - 1
        total = log_sum(f[ends] + r[ends], 1)
        totals[chosen] = total
        posterior[rows] = np.exp(f[row, column] + r[row, column] - total[row][:, None])
        follows = np.flatnonzero(column > 0)
        i, t = row[follows], column[follows]
        each = np.exp(f[i, t - 1][:, :, None] + np.broadcast_to(lm, (len(sizes), k, k))[i] + (b[i, t] + r[i, t])[:, None, :] - total[i][:, None, None])
        np.add.at(moves, chosen[i], each)
        if earlier is not None:
            into = np.exp(np.nan_to_num(earlier, nan=-np.inf, neginf=-np.inf)[:, :, None] + lm + (b[:, 0] + r[:, 0])[:, None, :] - total[:, None, None])
            moves[chosen] += into
    return posterior, moves, totals


def viterbi(x: np.ndarray, first: np.ndarray, start: np.ndarray, move: np.ndarray, means: np.ndarray, variances: np.ndarray, before: np.ndarray | None = None, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of sequences one after the other: the likeliest states (ties: the lower state), and each sequence's log-probability.

    Of a block of a longer sequence, ``before`` holds the best paths' log-probabilities at the row before it (NaN: it is the
    first) and ``ends`` the state in which it has to end.
    """
    k = np.shape(means)[-1]
    path, totals = np.zeros(len(x), int), np.zeros(len(first) - 1)
    for chosen in by_length(first):
        sizes, rows, sub = _chosen(first, chosen)
        ls, lm, m, v2 = _each(chosen, start, move, means, variances)
        v, (row, column) = padded(x[rows], sub)
        b = log_normal(v, m, v2)
        best, came = _entered(ls, lm, None if before is None else before[chosen], np.max) + b[:, 0], np.zeros(b.shape, np.int8)
        for t in range(1, v.shape[1]):
            each = best[:, :, None] + lm
            came[:, t] = each.argmax(axis=1)
            best = np.where((t < sizes)[:, None], each.max(axis=1) + b[:, t], best)
        states, at = np.zeros(v.shape, int), np.arange(len(sizes))
        now = best.argmax(axis=1) if ends is None else ends[chosen]
        totals[chosen] = best[at, now]
        for t in range(v.shape[1] - 1, -1, -1):
            states[:, t] = now
            now = np.where((0 < t) & (t < sizes), came[at, t, now], now)
        path[rows] = states[row, column]
    return path, totals


def transfers(x: np.ndarray, first: np.ndarray, begins: np.ndarray, start: np.ndarray, move: np.ndarray, means: np.ndarray, variances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of blocks one after the other, from each state at the row before to each state at the last row: the log of the sum over all paths, and of the best path.

    Where a sequence ``begins`` with a block, its start is in place of the first move, from whatever state.
    """
    k = len(means)
    sums, bests = np.zeros((len(first) - 1, k, k)), np.zeros((len(first) - 1, k, k))
    with np.errstate(divide="ignore"):
        ls, lm = np.log(start), np.log(move)
    for chosen in by_length(first):
        sizes, rows, sub = _chosen(first, chosen)
        v, _ = padded(x[rows], sub)
        b = log_normal(v, means, variances)
        total = np.where(begins[chosen][:, None, None], ls, lm) + b[:, 0][:, None, :]
        best = total.copy()
        for t in range(1, v.shape[1]):
            here, inside = b[:, t][:, None, :], (t < sizes)[:, None, None]
            total = np.where(inside, log_sum(total[:, :, :, None] + lm, 2) + here, total)
            best = np.where(inside, (best[:, :, :, None] + lm).max(axis=2) + here, best)
        sums[chosen], bests[chosen] = total, best
    return sums, bests


def fit_each(x: np.ndarray, first: np.ndarray, start: np.ndarray, move: np.ndarray, means: np.ndarray, variances: np.ndarray, rounds: int, tolerance: float, update: str, least: float) -> tuple[np.ndarray, ...]:
    """A model for each sequence by expectation maximisation from the given one: starts, moves, means, variances, log-likelihoods, rounds, settled or not.

    Sequences step together, each until its own gain is below the tolerance; the log-likelihood is that of the model returned.
    """
    n, k = len(first) - 1, np.shape(means)[-1]
    p = [np.broadcast_to(np.asarray(v, float), (n, *np.shape(v)[-d:])).copy() for v, d in ((start, 1), (move, 2), (means, 1), (variances, 1))]
    logl, took, settled = np.full(n, -np.inf), np.zeros(n, int), np.zeros(n, bool)
    open_ = np.arange(n)
    for step in range(rounds + 1):
        sizes, rows, sub = _chosen(first, open_)
        own = x[rows]
        gamma, moves, total = forward_backward(own, sub, *(v[open_] for v in p))
        gain = total - logl[open_]
        logl[open_] = total
        done = ~np.isfinite(total) | (gain < tolerance)
        settled[open_] = done
        if step == rounds or done.all():
            break
        w = np.maximum(np.add.reduceat(gamma, sub[:-1]), 1e-12)
        mean = np.add.reduceat(gamma * own[:, None], sub[:-1]) / w
        used = mean if "m" in update else p[2][open_]
        spread = np.add.reduceat(gamma * (own[:, None] - np.repeat(used, sizes, axis=0)) ** 2, sub[:-1]) / w
        out = moves.sum(axis=2, keepdims=True)
        new = (gamma[sub[:-1]], np.where(out > 0, moves / np.maximum(out, 1e-12), p[1][open_]), used, np.maximum(spread, least))
        go = open_[~done]
        for v, value, letter in zip(p, new, "stmc", strict=True):
            if letter in update:
                v[go] = value[~done]
        took[go] += 1
        open_ = go
    return (*p, logl, took, settled)


def _chosen(first: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some of the sequences: sizes, the numbers of their rows, and their bounds among these."""
    sizes = np.diff(first)[chosen]
    sub = np.concatenate([[0], np.cumsum(sizes)])
    return sizes, np.repeat(first[chosen] - sub[:-1], sizes) + np.arange(sub[-1]), sub


def kth_gap(x: np.ndarray, k: int) -> float:
    """The k-th smallest (from 0) distance of two of the sorted numbers, by bisection over the numbers a double can be: no table of pairs."""
    n, low, high = len(x), 0, int(np.float64(x[-1] - x[0]).view(np.int64))
    while low < high:
        middle = (low + high) // 2
        v = np.int64(middle).view(np.float64)
        if (np.searchsorted(x, x + v, "right") - np.arange(n) - 1).sum() > k:
            high = middle
        else:
            low = middle + 1
    return float(np.int64(low).view(np.float64))


def _sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(x)])


def gap_scale(x: np.ndarray) -> float:
    """The median squared distance of two of the numbers, 1 where that is 0 or there are none."""
    ordered, pairs = np.sort(x), len(x) * (len(x) - 1) // 2
    middle = (kth_gap(ordered, (pairs - 1) // 2) ** 2 + kth_gap(ordered, pairs // 2) ** 2) / 2 if pairs else 1.0
    return middle or 1.0


def moment_cost(n: np.ndarray, s: np.ndarray, q: np.ndarray, cost: str) -> np.ndarray:
    """The cost 'l2' or 'normal' of n numbers with the sum s and the sum of squares q."""
    n = np.maximum(n, 1)
    about = np.maximum(q - s**2 / n, 0.0)
    return about if cost == "l2" else n * np.log(about / n + 1e-6)


def segment_costs(x: np.ndarray, cost: str, cells: int = 1 << 20, scale: float | None = None) -> Callable[[int, int], tuple[np.ndarray, np.ndarray]]:
    """Of a segment [a, b): the costs of [a, k) and of [k, b) for k from a to b, those of nothing 0.

    'l2' about the mean, 'l1' about the median, 'normal' likelihood, or 'rbf' kernel (``scale``: by default the median
    squared distance). Up to ``cells`` kernel values are kept, as sums from which each segment's follow; of more, sums are
    added up anew for each segment by rows of ``cells`` at once, so memory grows with the segment, not with its square.
    """
    if cost in ("l2", "normal"):
        s, q = _sums(x), _sums(x * x)

        def moments(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
            k = np.arange(a, b + 1)

            def of(low, high):
                return np.where(high > low, moment_cost(high - low, s[high] - s[low], q[high] - q[low], cost), 0.0)

            return of(a, k), of(k, b)

        return moments
    if cost == "l1":
        away = lambda part: float(np.abs(part - np.median(part)).sum()) if len(part) else 0.0
        return lambda a, b: (np.array([away(x[a:k]) for k in range(a, b + 1)]), np.array([away(x[k:b]) for k in range(a, b + 1)]))
    if cost != "rbf":
        raise ValueError(f"no cost {cost!r}: l1, l2, normal or rbf")
    scale = gap_scale(x) if scale is None else scale
    if len(x) ** 2 <= cells:
        sums = np.zeros((len(x) + 1, len(x) + 1))
        sums[1:, 1:] = np.exp(-((x[:, None] - x[None, :]) ** 2) / scale).cumsum(axis=0).cumsum(axis=1)

        def kept(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
            k, diagonal = np.arange(b - a + 1), sums.diagonal()[a : b + 1]
            left = diagonal - sums[a, a : b + 1] - sums[a : b + 1, a] + sums[a, a]
            right = sums[b, b] - sums[a : b + 1, b] - sums[b, a : b + 1] + diagonal
            return k - left / np.maximum(k, 1), k[::-1] - right / np.maximum(k[::-1], 1)

        return kept

    def kernel(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        own, n = x[a:b], b - a
        before, every = np.zeros(n), np.zeros(n)
        for low in range(0, n, max(1, cells // n)):
            rows = slice(low, min(n, low + max(1, cells // n)))
            table = np.exp(-((own[rows, None] - own[None, :]) ** 2) / scale)
            every[rows] = table.sum(axis=1)
            before[rows] = np.where(np.arange(n)[None, :] < np.arange(n)[rows, None], table, 0.0).sum(axis=1)
        left, right = _sums(2 * before + 1), _sums((2 * (every - before - 1) + 1)[::-1])[::-1]
        k = np.arange(n + 1)
        return k - left / np.maximum(k, 1), (n - k) - right / np.maximum(n - k, 1)

    return kernel


def binary_segmentation(x: np.ndarray, penalty: float, cost: str = "rbf", jump: int = 5, least: int = 2, offset: int = 0, scale: float | None = None) -> list[int]:
    """Ends (exclusive) of the segments: the best split of any segment, again and again, while it gains more than the penalty.

    Splits are at multiples of ``jump``; ``offset`` is where the numbers begin in a longer series, whose places count.
    """
    if not len(x):
        return []
    of, ends, open_ = segment_costs(np.asarray(x, float), cost, scale=scale), [len(x)], [(0, len(x))]
    while open_:
        a, b = open_.pop()
        places = np.arange(-(-(offset + a + least) // jump) * jump, offset + b - least + 1, jump) - offset
        if not len(places):
            continue
        left, right = of(a, b)
        gains = left[-1] - left[places - a] - right[places - a]
        k = int(gains.argmax())
        if gains[k] > penalty:  # of one segment; what is split elsewhere doesn't matter to it
            ends.append(int(places[k]))
            open_ += [(a, int(places[k])), (int(places[k]), b)]
    return [offset + e for e in sorted(ends)]
