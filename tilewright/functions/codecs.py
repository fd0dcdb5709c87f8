"""Error-bounded number codecs for block data: encode to bytes, decode, and how many bits each value takes."""

from __future__ import annotations

import numpy as np


def eps_to_bits(eps: float) -> int:
    """Mantissa bits for a relative error of eps: at least one."""
    return max(1, int(np.ceil(-np.log2(eps))))


def exponent_bits(low: float, high: float) -> int:
    """Bits for the exponents between the smallest and largest magnitude."""
    span = np.log2(max(high / low, 1.0)) + 1
    return max(1, int(np.ceil(np.log2(span + 1))))


def _pack(codes: np.ndarray, bits: int) -> bytes:
    shifts = np.arange(bits, dtype=np.uint64)
    return np.packbits(((codes[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()


def _unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits).astype(np.uint64)
    return (flat << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def encode(values: np.ndarray, codec: str, eps: float) -> tuple[bytes, dict]:
    """Bytes and the header needed to decode them. All-zero data needs no bytes.

    fp32: plain cast. afl: sign, exponent over the data's range, and the mantissa bits eps asks for; code 0 is zero.
    aflp: the same, padded to whole bytes. bfp: signed integers of a common scale in whole bytes (eps is relative to the
    largest). fpx: the double's exponent with a cut mantissa, in whole bytes.
    """
    x = np.ascontiguousarray(values, dtype=np.float64).ravel()
    head = {"codec": codec, "n": x.size, "bits": 0, "scale": 1.0, "m": 0}
    mag = np.abs(x)
    if not mag.any():
        return b"", head
    if codec == "fp32":
        return x.astype("<f4").tobytes(), head | {"bits": 32}
    m = eps_to_bits(eps)
    if codec in ("afl", "aflp"):
        low, high = mag[mag > 0].min(), mag.max()
        e = exponent_bits(low, high)
        bits = 1 + e + m
        if codec == "aflp":
            bits = -(-bits // 8) * 8
            m = bits - 1 - e
        frac, power = np.frexp(np.where(mag > 0, mag / low, 1.0))  # in [0.5, 1) times 2^power, power >= 1
        whole = np.rint((2 * frac - 1) * 2.0**m).astype(np.uint64)
        carry = whole >> np.uint64(m)
        power = power.astype(np.uint64) + carry
        whole = np.where(carry > 0, np.uint64(0), whole)
        code = (power << np.uint64(m)) | whole
        code = np.where(mag > 0, (code << np.uint64(1)) | (x < 0).astype(np.uint64), np.uint64(0))
        return _pack(code, bits), head | {"bits": bits, "scale": float(low), "m": m}
    if codec == "bfp":
        bits = -(-(m + 2) // 8) * 8
        scale = float(mag.max()) / (2.0 ** (bits - 1) - 1)
        code = np.rint(x / scale).astype(np.int64) & ((1 << bits) - 1)
        return _pack(code.astype(np.uint64), bits), head | {"bits": bits, "scale": scale}
    if codec == "fpx":
        bits = -(-(12 + m) // 8) * 8
        cut = np.uint64(64 - bits)
        raw = x.view(np.uint64)
        if bits < 64:
            raw = (raw + (np.uint64(1) << (cut - np.uint64(1)))) >> cut
        return _pack(raw, bits), head | {"bits": bits}
    raise ValueError(f"unknown codec {codec}")


def decode(data: bytes, head: dict) -> np.ndarray:
    n, bits, codec = head["n"], head["bits"], head["codec"]
    if bits == 0:
        return np.zeros(n)
    if codec == "fp32":
        return np.frombuffer(data, "<f4").astype(np.float64)
    code = _unpack(data, bits, n)
    if codec in ("afl", "aflp"):
        m = np.uint64(head["m"])
        sign, body = (code & np.uint64(1)).astype(bool), code >> np.uint64(1)
        frac = (body & ((np.uint64(1) << m) - np.uint64(1))).astype(np.float64) / 2.0 ** head["m"]
        value = np.ldexp((1 + frac) * head["scale"] / 2, (body >> m).astype(np.int64))
        return np.where(code == 0, 0.0, np.where(sign, -value, value))
    if codec == "bfp":
        signed = code.astype(np.int64)
        return np.where(signed >= 1 << (bits - 1), signed - (1 << bits), signed) * head["scale"]
    return (code << np.uint64(64 - bits)).view(np.float64) if bits < 64 else code.view(np.float64)


CODECS = ("fp32", "afl", "aflp", "bfp", "fpx")


def column_tolerances(sigma: np.ndarray, delta: float) -> np.ndarray:
    """Relative error of each column of U diag(sigma) V^T so that the whole errs by delta: epsilon / sigma_i.

    epsilon solves (sum 1/sigma_i) epsilon^2 + epsilon = delta; columns with sigma 0 are to be dropped before.
    """
    p = 1.0 / (1.0 / sigma).sum()
    epsilon = -p / 2 + np.sqrt(p * p / 4 + delta * p)
    return epsilon / sigma
