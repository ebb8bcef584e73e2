"""Ground by triangulation, mask rules and connected parts, against definitions."""

import numpy as np
import pytest

from groundloom.operators import canopy, raster


def hull_area2(points):
    points = sorted(map(tuple, points.tolist()))

    def half(ps):
        h = []
        for q in ps:
            while len(h) > 1 and (h[-1][0] - h[-2][0]) * (q[1] - h[-2][1]) - (h[-1][1] - h[-2][1]) * (q[0] - h[-2][0]) <= 0:
                h.pop()
            h.append(q)
        return h

    h = half(points)[:-1] + half(points[::-1])[:-1]
    return abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(h, h[1:] + h[:1], strict=True)))


@pytest.mark.parametrize("n", [3, 5, 12, 40, 90])
def test_delaunay_circles_are_empty_and_the_hull_is_covered(n):
    r = np.random.default_rng(n)
    for _ in range(12):
        p = np.unique(r.integers(0, r.integers(3, 16), (n, 2)), axis=0)
        area = 0
        for t in canopy.delaunay(p):
            a, b, c = p[t]
            twice = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
            assert twice > 0
            area += twice
            m = np.array([[[*(q - d), ((q - d) ** 2).sum()] for q in (a, b, c)] for d in p], dtype=float)
            assert np.linalg.det(m).max() < 1e-6
        assert area == hull_area2(p)


def test_points_on_a_line_have_no_triangles():
    assert len(canopy.delaunay(np.array([[0, 0], [1, 1], [2, 2], [5, 5]]))) == 0


def test_ground_is_linear_inside_and_the_median_outside():
    rows, cols = np.indices((30, 40))
    plane = 3 + 0.5 * rows - 0.25 * cols
    known = np.random.default_rng(1).random(plane.shape) < 0.3
    ground = np.where(known, plane, np.nan)
    out = canopy.ground_surface(ground)
    off = np.abs(out - plane) > 1e-9
    assert not off[5:25, 5:35].any()
    assert np.allclose(out[off], np.median(plane[known]))
    corners = np.full(plane.shape, np.nan)
    corners[[0, 0, -1, -1], [0, -1, 0, -1]] = plane[[0, 0, -1, -1], [0, -1, 0, -1]]
    assert np.allclose(canopy.ground_surface(corners), plane)


def test_few_ground_cells_give_their_median():
    ground = np.full((6, 6), np.nan)
    assert (canopy.ground_surface(ground) == 0).all()
    ground[0, 0], ground[3, 3], ground[5, 5] = 1, 2, 9
    assert (canopy.ground_surface(ground) == 2).all()
    ground[4, 4] = 5  # four, all on one line
    out = canopy.ground_surface(ground)
    assert out[0, 5] == 3.5 and out[5, 5] == 9


def test_canopy_without_ground_and_with_a_buffer():
    top = np.full((12, 12), 100.0)
    top[5:8, 5:8] = 112
    top[0, 0] = np.nan
    none = np.full(top.shape, np.nan)
    high = canopy.canopy(top, none, resolution=1.0)
    assert np.isnan(high[0, 0]) and high[6, 6] == 12 and high[1, 1] == 0
    cut = canopy.canopy(top, none, resolution=2.0, buffer_px=3)
    assert cut.shape == (6, 6) and cut[3, 3] == 12
    assert canopy.canopy(top + 500, np.where(np.isnan(top), np.nan, 100.0)).max(initial=0, where=~np.isnan(top)) == 100


def test_no_data_takes_the_majority_of_its_border():
    tree = np.zeros((5, 5), bool)
    tree[:, 3:] = True
    nodata = np.zeros((5, 5), bool)
    nodata[2, 2] = nodata[0, 0] = nodata[4, 0:2] = True
    out, left = canopy.voted(tree, nodata, 1)
    assert left.tolist() == [[False] * 5] * 4 + [[True, True, False, False, False]]
    assert not out[0, 0] and not out[2, 2]
    tree[1, 2] = True
    assert canopy.voted(tree, nodata, 1)[0][2, 2]  # two of four
    bend = np.array([[1, 1, 0], [1, 0, 0], [0, 0, 0]], bool)  # the inner corner touches the part twice and counts once
    known = np.array([[0, 0, 1], [0, 0, 0], [1, 0, 0]], bool)
    assert canopy.voted(known, bend, 3)[0][0, 0]
    everything, still = canopy.voted(tree, np.ones((5, 5), bool), 99)
    assert still.all() and (everything == tree).all()


def test_masks_keep_large_gaps_and_lose_buildings():
    high = np.full((8, 8), 10.0)
    high[0:4, 0:4] = np.nan
    roofs = np.zeros((8, 8), bool)
    roofs[6:, 6:] = True
    tree, nodata = canopy.tree_mask(high, 4, roofs)
    assert nodata.sum() == 16 and not tree[nodata].any() and not tree[roofs].any() and tree.sum() == 64 - 16 - 4
    raw, _ = canopy.tree_mask(np.where(np.eye(8) > 0, 0.0, 10.0), 0)
    assert raw.sum() == 56


def test_components_equal_flooding():
    r = np.random.default_rng(3)
    for _ in range(60):
        mask = r.random((r.integers(1, 12), r.integers(1, 12))) < r.random()
        label = raster.components_of(mask)
        assert ((label > 0) == mask).all()
        seen = np.zeros(mask.shape, int)
        for n, start in enumerate(np.argwhere(mask), 1):
            todo = [tuple(start)] if not seen[tuple(start)] else []
            while todo:
                i, j = todo.pop()
                if 0 <= i < mask.shape[0] and 0 <= j < mask.shape[1] and mask[i, j] and not seen[i, j]:
                    seen[i, j] = n
                    todo += [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
        assert len(set(zip(label.ravel(), seen.ravel(), strict=True))) == len(set(label.ravel())) == len(set(seen.ravel()))
