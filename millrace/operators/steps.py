"""Bounded steps towards what earned more: what learned weights and searched policies have in common."""

from __future__ import annotations

import numpy as np


def excess(rewards: np.ndarray) -> np.ndarray:
    """What each reward has over their mean."""
    return rewards - rewards.mean()


def advantage(rewards: np.ndarray) -> np.ndarray:
    """What each reward has over the mean of the others."""
    n = len(rewards)
    return excess(rewards) * n / (n - 1) if n > 1 else rewards.copy()


def boxed(step: np.ndarray, most: float) -> np.ndarray:
    """No coordinate by more than `most`."""
    return np.minimum(np.maximum(step, -most), most)


def shortened(step: np.ndarray, scale: np.ndarray, most: float) -> np.ndarray:
    """Not longer than `most`, each coordinate counted in its own scale."""
    size = float(np.sqrt(np.sum((step / scale) ** 2)))
    return step if size <= most else step * (most / size)


def lifted(weights: np.ndarray, least: float) -> np.ndarray:
    """Weights raised to a floor, and their sum back to 1."""
    raised = np.where(weights < least, least, weights)
    return raised / raised.sum()


def softmax(theta: np.ndarray) -> np.ndarray:
    e = np.exp(theta - theta.max())
    return e / e.sum()


def logistic(x: float, top: float) -> float:
    """From 0 to `top`."""
    return top / (1.0 + float(np.exp(-x)))
