"""NumPy kernels on single volumes (z, y, x) or stacks: resampling, Fourier shifts, registration, deconvolution, reconstruction, labels."""

from __future__ import annotations

import numpy as np


def rotation_matrix(rot1: float, rot2: float, rot3: float) -> np.ndarray:
    """Rx(rot1) Rz(rot2) Rx(rot3), degrees."""
    a, b, c = np.radians([rot1, rot2, rot3])
    rx = lambda t: np.array([[1, 0, 0], [0, np.cos(t), -np.sin(t)], [0, np.sin(t), np.cos(t)]])
    rz = np.array([[np.cos(b), -np.sin(b), 0], [np.sin(b), np.cos(b), 0], [0, 0, 1]])
    return rx(a) @ rz @ rx(c)


def spline_coefficients(volume: np.ndarray) -> np.ndarray:
    """Coefficients of the cubic B-spline that goes through every voxel, the volume being mirrored about its outermost voxels."""
    pole = np.sqrt(3.0) - 2
    out = np.asarray(volume, float)
    for axis in range(out.ndim):
        n = out.shape[axis]
        if n < 2:
            continue
        c = np.moveaxis(out, axis, 0) * 6.0
        # the sum over all mirror images, in closed form
        powers = pole ** np.arange(n)
        whole = powers.copy()
        whole[1:-1] += pole ** (2 * n - 2 - np.arange(1, n - 1))
        first = np.tensordot(whole, c, (0, 0)) / (1 - pole ** (2 * n - 2))
        forth = np.empty_like(c)
        forth[0] = first
        for i in range(1, n):
            forth[i] = c[i] + pole * forth[i - 1]
        back = np.empty_like(c)
        back[-1] = pole / (pole**2 - 1) * (forth[-1] + pole * forth[-2])
        for i in range(n - 2, -1, -1):
            back[i] = pole * (back[i + 1] - forth[i])
        out = np.moveaxis(back, 0, axis)
    return out


def affine(volume: np.ndarray, matrix: np.ndarray, offset: np.ndarray, shape: tuple[int, ...] | None = None, order: int = 1) -> np.ndarray:
    """Resampling by splines of order 0, 1 or 3: output voxel o takes the input at matrix @ o + offset, 0 outside. A leading axis of channels is kept.

    Cubic splines take mirrored voxels where their support leaves the volume; places outside the volume itself are 0 for every order.
    """
    if order not in (0, 1, 3):
        raise ValueError("the order must be 0, 1 or 3")
    if volume.ndim == 4:
        return np.stack([affine(v, matrix, offset, shape, order) for v in volume])
    shape = volume.shape if shape is None else shape
    grid = np.stack(np.meshgrid(*(np.arange(n) for n in shape), indexing="ij"), -1).reshape(-1, 3)
    at = grid @ np.asarray(matrix, float).T + np.asarray(offset, float)
    at = np.where(np.abs(at - np.rint(at)) < 1e-9, np.rint(at), at)
    if order == 3:
        return _cubic(spline_coefficients(volume), at).reshape(shape)
    if order == 0:
        at = np.floor(at + 0.5)
    low = np.floor(at).astype(int)
    part = at - low
    out = np.zeros(len(at))
    for corner in np.ndindex(2, 2, 2):
        idx = low + corner
        weight = np.where(corner, part, 1 - part).prod(1)
        inside = ((idx >= 0) & (idx < volume.shape)).all(1) & (weight > 0)
        out[inside] += weight[inside] * volume[tuple(idx[inside].T)]
    return out.reshape(shape)


def _cubic(coefficients: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values of a cubic B-spline at places (n, 3); 0 outside the volume."""
    size = np.asarray(coefficients.shape)
    inside = ((at >= 0) & (at <= size - 1)).all(1)
    at, out = at[inside], np.zeros(len(at))
    low = np.floor(at).astype(int)
    t = at - low
    weights = np.stack([(1 - t) ** 3, 3 * t**3 - 6 * t**2 + 4, 3 * (1 - t) ** 3 - 6 * (1 - t) ** 2 + 4, t**3]) / 6
    total = np.zeros(len(at))
    for k in np.ndindex(4, 4, 4):
        idx = np.abs(low + np.array(k) - 1)
        idx = np.where(idx > size - 1, 2 * (size - 1) - idx, idx)
        idx = np.clip(idx, 0, size - 1)
        total += weights[k[0], :, 0] * weights[k[1], :, 1] * weights[k[2], :, 2] * coefficients[tuple(idx.T)]
    out[inside] = total
    return out


def pose_affine(shape: tuple[int, ...], pose: np.ndarray, inverse: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, offset) that moves a volume by a pose (three angles, three translations) about its centre; inverse moves it back."""
    c = (np.asarray(shape) - 1) / 2
    r, t = rotation_matrix(*pose[:3]), np.asarray(pose[3:], float)
    if inverse:  # output o looks at the input where the pose puts it
        return r, c + t - r @ c
    return r.T, c - r.T @ (c + t)


def rotate(volume: np.ndarray, pose: np.ndarray, inverse: bool = False, order: int = 1) -> np.ndarray:
    return affine(volume, *pose_affine(volume.shape[-3:], np.asarray(pose, float), inverse), order=order)


def resample(volume: np.ndarray, scale: float | tuple[float, ...], order: int = 1) -> np.ndarray:
    """Zoom that keeps the centre; the output has round(shape * scale) voxels, half to even."""
    s = np.broadcast_to(np.asarray(scale, float), 3)
    size = np.asarray(volume.shape[-3:])
    shape = tuple(int(n) for n in np.rint(size * s))
    matrix = np.diag(1 / s)
    return affine(volume, matrix, (size - 1) / 2 - matrix @ ((np.asarray(shape) - 1) / 2), shape, order)


def to_size(volume: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Centred pad or crop, by half voxels where parities differ."""
    return affine(volume, np.eye(3), (np.asarray(volume.shape) - np.asarray(shape)) / 2, shape)


def crop_padded(volume: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """volume[low:high], 0 outside."""
    out = np.zeros(tuple(np.asarray(high) - np.asarray(low)), volume.dtype)
    a, b = np.maximum(low, 0), np.minimum(high, volume.shape)
    if (a < b).all():
        out[tuple(slice(i, j) for i, j in zip(a - low, b - low, strict=True))] = volume[tuple(slice(i, j) for i, j in zip(a, b, strict=True))]
    return out


def translate(volume: np.ndarray, vector, order: int = 1) -> np.ndarray:
    return affine(volume, np.eye(3), -np.asarray(vector, float), order=order)


def mass_center(volume: np.ndarray) -> np.ndarray:
    grid = np.indices(volume.shape).reshape(volume.ndim, -1)
    return grid @ volume.ravel() / volume.sum()


def centered(volume: np.ndarray, order: int = 1) -> np.ndarray:
    """The centre of mass (of each channel its own) moved to (shape - 1) / 2."""
    if volume.ndim == 4:
        return np.stack([centered(v, order) for v in volume])
    return translate(volume, (np.asarray(volume.shape) - 1) / 2 - mass_center(volume), order)


def fourier_shift(spectrum: np.ndarray, vector) -> np.ndarray:
    """The spectrum of the array shifted by a vector, fractions included."""
    phase = np.zeros((1,) * spectrum.ndim)
    for axis, (n, s) in enumerate(zip(spectrum.shape, vector, strict=True)):
        phase = phase + (np.fft.fftfreq(n) * s).reshape([-1 if k == axis else 1 for k in range(spectrum.ndim)])
    return spectrum * np.exp(-2j * np.pi * phase)


def register(reference: np.ndarray, moving: np.ndarray, upsample: int = 10, normalize: bool = False) -> tuple[np.ndarray, float]:
    """(shift that brings moving onto reference, error sqrt(|1 - |cc|^2 / (E1 E2)|)) by phase cross-correlation.

    The whole-pixel peak is refined by a matrix Fourier transform of the cross-power spectrum on a fine grid of 1.5 pixels around it.
    """
    f, g = np.fft.fftn(reference), np.fft.fftn(moving)
    cross = f * g.conj()
    if normalize:
        cross = cross / np.maximum(np.abs(cross), 100 * np.finfo(float).eps)
    size, shape = f.size, np.asarray(f.shape)
    power = (np.abs(f) ** 2).sum() / size * (np.abs(g) ** 2).sum() / size
    cc = np.fft.ifftn(cross)
    peak = np.asarray(np.unravel_index(np.argmax(np.abs(cc)), cc.shape))
    shift = np.where(peak > shape // 2, peak - shape, peak).astype(float)
    best = cc[tuple(peak)]
    if upsample > 1:
        n = int(np.ceil(1.5 * upsample))
        fine = np.rint(shift * upsample) / upsample
        steps = (np.arange(n) - n // 2) / upsample
        out = cross
        for axis in range(cross.ndim):
            kernel = np.exp(2j * np.pi * np.outer(fine[axis] + steps, np.fft.fftfreq(f.shape[axis])))
            out = np.moveaxis(np.tensordot(kernel, out, axes=(1, axis)), 0, axis)
        at = np.asarray(np.unravel_index(np.argmax(np.abs(out)), out.shape))
        shift, best = fine + steps[at], out[tuple(at)] / size
    shift = np.where(shape == 1, 0.0, shift)
    error = float(np.sqrt(np.abs(1 - np.abs(best) ** 2 / power))) if power > 0 else 0.0
    return shift + 0.0, error


def otsu(values: np.ndarray, bins: int = 256) -> float:
    """Otsu's threshold: the bin centre that separates two classes best."""
    hist, edges = np.histogram(values, bins)
    centers = (edges[1:] + edges[:-1]) / 2
    w1, s1 = hist.cumsum(), (hist * centers).cumsum()
    w2, s2 = w1[-1] - w1, s1[-1] - s1
    spread = np.where((w1 > 0) & (w2 > 0), w1 * w2 * (s1 / np.maximum(w1, 1) - s2 / np.maximum(w2, 1)) ** 2, 0)
    return float(centers[np.argmax(spread)])


def label(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Face-connected components: labels from 1 in scan order, by least-index propagation."""
    ids = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        new = ids.copy()
        for axis in range(mask.ndim):
            a = [slice(None)] * mask.ndim
            b = list(a)
            a[axis], b[axis] = slice(1, None), slice(None, -1)
            a, b = tuple(a), tuple(b)
            both = mask[a] & mask[b]
            low = np.minimum(new[a], new[b])
            new[a] = np.where(both, low, new[a])
            new[b] = np.where(both, np.minimum(new[b], low), new[b])
        flat = np.concatenate([[0], new.ravel()])
        jumped = flat[new]
        new = np.where(mask, np.minimum(new, np.where(jumped > 0, jumped, new)), 0)
        if (new == ids).all():
            break
        ids = new
    names, out = np.unique(ids, return_inverse=True)
    out = out.reshape(mask.shape)
    return (out if 0 in names else out + 1), int((names > 0).sum())


def remove_small(mask: np.ndarray, least: int) -> np.ndarray:
    """The components of at least so many voxels, each by its own area."""
    ids, n = label(mask)
    keep = np.bincount(ids.ravel(), minlength=n + 1) >= least
    keep[0] = False
    return keep[ids]


def largest_centered(volume: np.ndarray) -> np.ndarray:
    """The largest component over Otsu's threshold rolled to the centre."""
    ids, n = label(volume > otsu(volume))
    if not n:
        return volume
    top = np.argmax(np.bincount(ids.ravel())[1:]) + 1
    move = (np.asarray(volume.shape) - 1) / 2 - np.argwhere(ids == top).mean(0)
    return np.roll(volume, np.rint(move).astype(int), tuple(range(volume.ndim)))


def _laplacian_power(shape: tuple[int, ...]) -> np.ndarray:
    """Squared modulus of the transfer function of forward differences, summed over axes."""
    total = np.zeros(shape)
    for axis, n in enumerate(shape):
        total = total + (np.abs(1 - np.exp(-2j * np.pi * np.fft.fftfreq(n))) ** 2).reshape([-1 if k == axis else 1 for k in range(len(shape))])
    return total


def centered_transfer(psf: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Spectrum of a point-spread function padded to a shape, its middle at the origin."""
    out = np.zeros(shape)
    small = psf[tuple(slice(max(0, (n - m) // 2), max(0, (n - m) // 2) + min(n, m)) for n, m in zip(psf.shape, shape, strict=True))]
    out[tuple(slice(0, n) for n in small.shape)] = small
    return np.fft.fftn(np.roll(out, [-(n // 2) for n in small.shape], tuple(range(out.ndim))))


def deconvolve(volume: np.ndarray, psf: np.ndarray, weight: float) -> np.ndarray:
    """Wiener-type inverse with a penalty on gradients, negative values cut."""
    h = centered_transfer(psf, volume.shape)
    out = np.fft.ifftn(h.conj() * np.fft.fftn(volume) / (np.abs(h) ** 2 + weight * _laplacian_power(volume.shape) + 1e-30)).real
    return np.maximum(out, 0)


def reconstruction_sums(volume: np.ndarray, psf: np.ndarray, pose: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numerator, denominator) that a particle adds to a least-squares reconstruction; sums of these merge in any order."""
    turned = rotate(to_size(psf, volume.shape), np.concatenate([np.asarray(pose[:3], float), np.zeros(3)]), inverse=True)
    h = fourier_shift(np.fft.fftn(turned), [-(n - 1) / 2 for n in volume.shape])
    y = np.fft.fftn(rotate(volume, pose, inverse=True))
    return h.conj() * y, np.abs(h) ** 2


def reconstruct(numerator: np.ndarray, denominator: np.ndarray, n: int, weight: float) -> np.ndarray:
    """The volume of accumulated sums of n particles, with a gradient penalty, negative values cut."""
    out = np.fft.ifftn(numerator / n / (denominator / n + weight * _laplacian_power(numerator.shape) + 1e-30)).real
    return np.maximum(out, 0)


def match_pose(reference: np.ndarray, volume: np.ndarray, psf: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, float]:
    """(best pose, its error) among candidates: the reference is turned, blurred and registered; the translation is minus the shift."""
    h = centered_transfer(psf, volume.shape)
    best, least = None, np.inf
    for pose in candidates:
        turned = np.concatenate([pose[:3], np.zeros(3)])
        seen = np.fft.ifftn(np.fft.fftn(rotate(reference, turned)) * h).real
        shift, error = register(seen, volume)
        if error < least:
            best, least = np.concatenate([pose[:3], -shift]), error
    return best, least


def gaussian_blur(volume: np.ndarray, sigma: tuple[float, ...]) -> np.ndarray:
    """Separable Gaussian filter, borders mirrored."""
    out = volume.astype(float)
    for axis, s in enumerate(sigma):
        if s <= 0:
            continue
        r = int(4 * s + 0.5)
        k = np.exp(-0.5 * (np.arange(-r, r + 1) / s) ** 2)
        padded = np.pad(out, [(r, r) if a == axis else (0, 0) for a in range(out.ndim)], mode="symmetric")
        out = np.apply_along_axis(lambda v, k=k / k.sum(): np.convolve(v, k, "valid"), axis, padded)
    return out


def symmetry_axis(volume: np.ndarray, threshold: float) -> np.ndarray:
    """Principal axis of the voxels over a threshold whose spread differs most from the other two."""
    points = np.argwhere(volume >= threshold).astype(float)
    _, s, v = np.linalg.svd(points - points.mean(0), full_matrices=False)
    gaps = [min(abs(s[i] - s[j]) for j in range(3) if j != i) for i in range(3)]
    return v[int(np.argmax(gaps))]


def recenter_box(box: np.ndarray, volume: np.ndarray, least: float = 1.0, most: int = 1000) -> np.ndarray:
    """A box (x1, y1, z1, x2, y2, z2) moved onto the centroid of its bright part (over Otsu's threshold) until it moves by `least` or less.

    A step that would leave the image is taken back; NaN for a box that holds nothing.
    """
    low, high = np.asarray(box[:3][::-1], int), np.asarray(box[3:][::-1], int)
    size = high - low
    for _ in range(most):
        a, b = np.maximum(low, 0), np.minimum(high, volume.shape)
        crop = volume[tuple(slice(i, j) for i, j in zip(a, b, strict=True))]
        if not crop.size:
            return np.full(6, np.nan)
        bright = np.argwhere(crop > otsu(crop))
        if not len(bright):
            return np.full(6, np.nan)
        new = np.rint(bright.mean(0) + low - size / 2).astype(int)
        if (new < 0).any() or (new + size > volume.shape).any():
            break
        moved = np.linalg.norm(new - low)
        low, high = new, new + size
        if moved <= least:
            break
    return np.concatenate([low[::-1], high[::-1]]).astype(float)


def dbscan(points: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Density clusters of points: labels from 1, noise 0. Neighbours are sought in grid cells of side eps."""
    cells: dict[tuple, list[int]] = {}
    keys = [tuple(k) for k in np.floor(points / eps).astype(int)]
    for i, k in enumerate(keys):
        cells.setdefault(k, []).append(i)
    around = [[j for d in np.ndindex(3, 3, 3) for j in cells.get(tuple(np.add(k, d) - 1), ()) if np.linalg.norm(points[i] - points[j]) <= eps] for i, k in enumerate(keys)]
    out, n = np.zeros(len(points), int), 0
    for i in range(len(points)):
        if out[i] or len(around[i]) < least:
            continue
        n += 1
        todo = [i]
        out[i] = n
        while todo:
            for j in around[todo.pop()]:
                if not out[j]:
                    out[j] = n
                    if len(around[j]) >= least:
                        todo.append(j)
    return out


def tiles(shape: tuple[int, ...], most: int) -> list[tuple[tuple[int, int], ...]]:
    """Tiles of at most `most` cells that cover an n-dimensional index box exactly once."""
    out, rest = [tuple((0, n) for n in shape)], []
    while out:
        t = out.pop()
        size = int(np.prod([b - a for a, b in t]))
        if size <= most:
            rest.append(t)
            continue
        axis = int(np.argmax([b - a for a, b in t]))
        a, b = t[axis]
        out += [(*t[:axis], (a, (a + b) // 2), *t[axis + 1 :]), (*t[:axis], ((a + b) // 2, b), *t[axis + 1 :])]
    return sorted(rest)


def align_pair(reference: np.ndarray, moving: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, float]:
    """(pose, error) of the candidate rotation after which moving registers best with reference."""
    psf = np.zeros((3,) * 3)
    psf[1, 1, 1] = 1
    pose, error = match_pose(moving, reference, psf, candidates)
    return pose, error


def iterative_average(volumes: list[np.ndarray], candidates: np.ndarray, rounds: int = 2, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(average, poses): particles are aligned in a seeded order to the running average, then each to the average of the others.

    Sequential by nature: each alignment needs the average before it.
    """
    order = np.random.default_rng(seed).permutation(len(volumes))
    poses = np.zeros((len(volumes), 6))
    moved = [v.copy() for v in volumes]
    total = volumes[order[0]].copy()
    for n, i in enumerate(order[1:], 1):
        poses[i], _ = align_pair(total / n, volumes[i], candidates)
        moved[i] = rotate(volumes[i], poses[i])
        total = total + moved[i]
    for _ in range(rounds):
        for i in order:
            rest = total - moved[i]
            poses[i], _ = align_pair(rest / max(1, len(volumes) - 1), volumes[i], candidates)
            moved[i] = rotate(volumes[i], poses[i])
            total = rest + moved[i]
    return total / len(volumes), poses


def suppress_outliers(volumes: list[np.ndarray], n: int) -> list[int]:
    """Indices of n volumes, halving the set by distance from its mean until no more than n are left or the next half would be fewer."""
    keep = list(range(len(volumes)))
    while len(keep) > n:
        mean = np.mean([volumes[i] for i in keep], 0)
        far = [float(np.abs(volumes[i] - mean).mean()) for i in keep]
        order = [keep[j] for j in np.argsort(far, kind="stable")]
        keep = sorted(order[: max(n, (len(keep) + 1) // 2)])
    return keep


def polar(image: np.ndarray, n_angles: int, n_radii: int) -> np.ndarray:
    """Bilinear polar resampling of a square image about its centre."""
    c = (np.asarray(image.shape) - 1) / 2
    t = 2 * np.pi * np.arange(n_angles)[:, None] / n_angles
    r = np.arange(n_radii)[None] * c.min() / max(1, n_radii - 1)
    y, x = c[0] + r * np.sin(t), c[1] + r * np.cos(t)
    y0, x0 = np.clip(np.floor(y).astype(int), 0, image.shape[0] - 2), np.clip(np.floor(x).astype(int), 0, image.shape[1] - 2)
    fy, fx = y - y0, x - x0
    return image[y0, x0] * (1 - fy) * (1 - fx) + image[y0 + 1, x0] * fy * (1 - fx) + image[y0, x0 + 1] * (1 - fy) * fx + image[y0 + 1, x0 + 1] * fy * fx


def in_plane_angle(reference: np.ndarray, moving: np.ndarray, n_angles: int = 360) -> float:
    """Degrees by which moving is turned against reference, from the circular correlation of their polar images."""
    radii = min(reference.shape) // 2
    a, b = polar(reference, n_angles, radii), polar(moving, n_angles, radii)
    cc = np.fft.ifft(np.fft.fft(a, axis=0).conj() * np.fft.fft(b, axis=0), axis=0).real.sum(1)
    return float(np.argmax(cc) * 360 / n_angles)


def erode(mask: np.ndarray, times: int = 1) -> np.ndarray:
    """Erosion by face neighbours; outside counts as empty."""
    for _ in range(times):
        padded, out = np.pad(mask, 1), mask.copy()
        for axis in range(mask.ndim):
            for step in (0, 2):
                out &= padded[tuple(slice(step, step + n) if a == axis else slice(1, 1 + n) for a, n in enumerate(mask.shape))]
        mask = out
    return mask


def dilate(mask: np.ndarray, times: int = 1) -> np.ndarray:
    for _ in range(times):
        padded, out = np.pad(mask, 1), mask.copy()
        for axis in range(mask.ndim):
            for step in (0, 2):
                out |= padded[tuple(slice(step, step + n) if a == axis else slice(1, 1 + n) for a, n in enumerate(mask.shape))]
        mask = out
    return mask


def foreground_mask(volume: np.ndarray, gamma: float = 0.5, least: int = 8, grow: int = 10) -> np.ndarray:
    """Likely foreground: gamma, the midpoint between the two class means of the brightest slice, small parts removed, eroded once and grown."""
    v = (volume - volume.min()) / max(volume.max() - volume.min(), 1e-12)
    v = v**gamma
    part = v[np.argmax(v.mean((1, 2)))].ravel()
    low, high = np.quantile(part, [0.1, 0.9])
    for _ in range(100):  # two-class mixture with a common spread, by hard assignment
        cut = (low + high) / 2
        a, b = part[part <= cut], part[part > cut]
        new = (a.mean() if len(a) else low, b.mean() if len(b) else high)
        if np.allclose(new, (low, high)):
            break
        low, high = new
    return dilate(erode(remove_small(v > (low + high) / 2, least)), grow)


def hull_fill(mask: np.ndarray) -> np.ndarray:
    """Each z slice filled to the convex hull of its voxels (monotone chain, then half planes)."""
    out = np.zeros(mask.shape, bool)
    grid = np.indices(mask.shape[1:]).reshape(2, -1).T
    for z, plane in enumerate(mask):
        pts = sorted(map(tuple, np.argwhere(plane)))
        if len(pts) < 3:
            out[z] = plane
            continue
        turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
        hull = []
        for chain in (pts, pts[::-1]):
            part: list = []
            for p in chain:
                while len(part) > 1 and turn(part[-2], part[-1], p) <= 0:
                    part.pop()
                part.append(p)
            hull += part[:-1]
        h = np.array(hull)
        inside = np.ones(len(grid), bool)
        for a, b in zip(h, np.roll(h, -1, 0), strict=True):
            inside &= (b[0] - a[0]) * (grid[:, 1] - a[1]) - (b[1] - a[1]) * (grid[:, 0] - a[0]) >= 0
        out[z] = inside.reshape(plane.shape) | plane
    return out


def keep_low_frequencies(volume: np.ndarray, size: int, seed: int | None = None) -> np.ndarray:
    """The central cube of the spectrum; elsewhere zero, or seeded noise of the spectrum's median modulus."""
    f = np.fft.fftshift(np.fft.fftn(volume))
    inside = np.ones(f.shape, bool)
    for axis, n in enumerate(f.shape):
        near = np.abs(np.arange(n) - n // 2) <= size // 2
        inside &= near.reshape([-1 if k == axis else 1 for k in range(f.ndim)])
    other = np.zeros_like(f)
    if seed is not None:
        rng = np.random.default_rng(seed)
        other = np.median(np.abs(f)) * (rng.standard_normal(f.shape) + 1j * rng.standard_normal(f.shape))
    return np.fft.ifftn(np.fft.ifftshift(np.where(inside, f, other))).real


def to_bytes(volume: np.ndarray, stretch: bool = False) -> np.ndarray:
    """uint8 of an integer volume: as it is if under 0.1 % of the voxels exceed 255 (those are cut); otherwise stretched to 0..255, or left as int16."""
    if (volume > 255).mean() < 0.001:
        return np.clip(volume, 0, 255).astype(np.uint8)
    if not stretch:
        return volume.astype(np.int16)
    low, high = volume.min(), volume.max()
    return np.rint((volume - low) / max(high - low, 1e-12) * 255).astype(np.uint8)


def axis_rotation(axis: np.ndarray) -> np.ndarray:
    """The rotation matrix that takes (1, 0, 0), the z direction of a volume, to an axis."""
    a = np.asarray(axis, float) / np.linalg.norm(axis)
    a = a if a[0] >= 0 else -a
    v = np.cross([1.0, 0.0, 0.0], a)
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    return np.eye(3) + k + k @ k / (1 + a[0])


def ring_center(image: np.ndarray, symmetry: int, precision: float = 1.0) -> np.ndarray:
    """Shift (y, x) that makes a plane most alike to its own turns by 360 / symmetry about the centre: a grid of shifts scored by mean correlation."""
    n = int(np.ceil(max(image.shape) / (4 * precision)))
    steps = [np.linspace(-1, 1, n) * s / 4 for s in image.shape]
    best, found = -np.inf, np.zeros(2)
    for dy in steps[0]:
        for dx in steps[1]:
            moved = translate(image[None], (0, dy, dx))[0]
            score = 0.0
            for s in range(1, symmetry):
                t = 2 * np.pi * s / symmetry
                m = np.array([[1, 0, 0], [0, np.cos(t), -np.sin(t)], [0, np.sin(t), np.cos(t)]])
                c = np.array([0, *((np.asarray(image.shape) - 1) / 2)])
                turned = affine(moved[None], m, c - m @ c)[0]
                a, b = moved - moved.mean(), turned - turned.mean()
                score += (a * b).mean() / max(a.std() * b.std(), 1e-12) / max(1, symmetry - 1)
            if score > best + 1e-12:
                best, found = score, np.array([dy, dx])
    return found


def density_tree(points: np.ndarray, least: int = 5, samples: int | None = None) -> np.ndarray:
    """Hierarchical density clusters from 1, noise 0: clusters of at least `least` points that last longest as the density threshold rises.

    Distances are raised to the distance of the samples-th neighbour (the point itself is its first) of either end; the minimum spanning tree of these is cut from
    its longest edge down. A cluster's weight is the sum over its points of how much density (one over distance) they stay in it; children are kept where they weigh
    more than their parent, and the whole is no cluster.
    """
    n, samples = len(points), samples or least
    label = np.zeros(n, int)
    if n < max(2, least):
        return label
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    core = np.sort(d, 1)[:, min(samples, n) - 1]
    d = np.maximum(d, np.maximum.outer(core, core))
    near, source, left = d[0].copy(), np.zeros(n, int), np.ones(n, bool)
    left[0] = False
    edges = []
    for _ in range(n - 1):
        j = int(np.where(left, near, np.inf).argmin())
        edges.append((near[j], source[j], j))
        left[j] = False
        closer = left & (d[j] < near)
        near[closer], source[closer] = d[j][closer], j
    # merges from the shortest edge up: nodes n, n + 1, ...
    top, kids, leaves = list(range(n)), {}, {i: [i] for i in range(n)}

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for k, (length, a, b) in enumerate(sorted(edges)):
        a, b = find(int(a)), find(int(b))
        top.append(n + k)
        top[a] = top[b] = n + k
        kids[n + k] = (a, b, length)
        leaves[n + k] = leaves[a] + leaves[b]
    birth, parent, weight, home = {0: 0.0}, {}, {0: 0.0}, {}
    todo = [(2 * n - 2, 0)]
    while todo:
        node, c = todo.pop()
        a, b, length = kids[node]
        density = 1 / max(length, 1e-12)
        big = [x for x in (a, b) if len(leaves[x]) >= least]
        for x in (a, b):
            if len(big) == 2 or x not in big:
                weight[c] += (density - birth[c]) * len(leaves[x])
            if len(big) == 2:
                new = len(birth)
                birth[new], parent[new], weight[new] = density, c, 0.0
                if x in kids:
                    todo.append((x, new))
                else:
                    home[x] = new
            elif x in big and x in kids:
                todo.append((x, c))
            else:
                home.update(dict.fromkeys(leaves[x], c))
    best, chosen = dict(weight), set()
    for c in sorted(birth, reverse=True):
        below = sum(best[x] for x in parent if parent[x] == c)
        if c == 0 or below > weight[c]:
            best[c] = below
        else:
            chosen.add(c)
    for point, c in home.items():
        found = 0
        while True:
            found = c if c in chosen else found
            if c not in parent:
                break
            c = parent[c]
        label[point] = found
    names = {c: i + 1 for i, c in enumerate(dict.fromkeys(x for x in label.tolist() if x))}
    return np.array([names.get(x, 0) for x in label.tolist()])
