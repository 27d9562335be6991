"""Cameras: the parameters of a query.  Matrices are made on the driver and become literals of the plan."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Camera:
    """A camera that orbits a target, and the size of its image."""

    yaw: float
    pitch: float
    radius: float
    target: tuple[float, float, float]
    width: int = 256
    height: int = 144
    fovy: float = 60.0
    near: float = 0.1
    far: float = 2e5

    def world(self) -> np.ndarray:
        """Camera space to world space: the view looks along its own negative z; at pitch 0 that is the world's y."""
        cy, sy, cp, sp = np.cos(self.yaw), np.sin(self.yaw), np.cos(self.pitch), np.sin(self.pitch)
        about_z = np.array([[cy, -sy, 0, 0], [sy, cy, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]], float)
        about_x = np.array([[1, 0, 0, 0], [0, cp, -sp, 0], [0, sp, cp, 0], [0, 0, 0, 1]], float)
        upright = np.array([[1, 0, 0, 0], [0, 0, -1, 0], [0, 1, 0, 0], [0, 0, 0, 1]], float)
        to, back = np.eye(4), np.eye(4)
        to[:3, 3], back[2, 3] = self.target, self.radius
        return to @ about_z @ about_x @ upright @ back

    def view(self) -> np.ndarray:
        return np.linalg.inv(self.world())

    def projection(self) -> np.ndarray:
        f = 1 / np.tan(np.radians(self.fovy) / 2)
        n, z = self.near, self.far
        return np.array([[f * self.height / self.width, 0, 0, 0], [0, f, 0, 0], [0, 0, (z + n) / (n - z), 2 * z * n / (n - z)], [0, 0, -1, 0]], float)

    def transform(self) -> np.ndarray:
        """World space to clip space."""
        return self.projection() @ self.view()

    def eye(self) -> np.ndarray:
        return self.world()[:3, 3]

    def planes(self) -> np.ndarray:
        """The frustum's six planes (normal, constant), inside where the distance is positive."""
        m = self.transform()
        p = np.array([m[3] + s * m[i] for i in range(3) for s in (1, -1)])
        return p / np.linalg.norm(p[:, :3], axis=1, keepdims=True)

    def under_cursor(self, px: float, py: float, depth: float) -> np.ndarray:
        """The world point at a distance along the view axis under a pixel."""
        up = np.tan(np.radians(self.fovy) / 2)
        x, y = (2 * (px + 0.5) / self.width - 1) * up * self.width / self.height, (2 * (py + 0.5) / self.height - 1) * up
        return (self.world() @ np.array([x * depth, y * depth, -depth, 1.0]))[:3]

    def shifted(self, right: float) -> "Camera":
        """The camera moved to its right, as the other eye of a pair."""
        axis = self.world()[:3, 0]
        return Camera(self.yaw, self.pitch, self.radius, tuple(np.array(self.target) + right * axis), self.width, self.height, self.fovy, self.near, self.far)


#: Views of the points that `cairn.points` derives.
PRESETS = {
    "overview": Camera(0.4, -0.5, 70_000.0, (50_000.0, 500.0, 5_000.0)),
    "close": Camera(-0.7, -0.3, 9_000.0, (30_000.0, 500.0, 4_000.0)),
    "edge": Camera(1.2, -0.8, 20_000.0, (80_000.0, 500.0, 2_000.0)),
}
