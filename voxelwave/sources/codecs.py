"""Byte codecs: NIfTI-1 images and vector warps, MATLAB level-4 affines, registration bundles. Formats are public standards."""

from __future__ import annotations

import gzip
import json
import os
import struct

import numpy as np

# ---------------------------------------------------------------- NIfTI-1

#: Fixed values of the format: data type codes.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
VECTOR_INTENT = 1007
RAS_TO_LPS = np.diag([-1.0, -1.0, 1.0, 1.0])


def read_nifti(raw: bytes) -> tuple[np.ndarray, np.ndarray, dict]:
    """(array, voxel-to-RAS, header fields)."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    if len(raw) < 348:
        raise ValueError("too short for a NIfTI-1 header")
    end = "<" if struct.unpack_from("<i", raw, 0)[0] == 348 else ">"
    if struct.unpack_from(f"{end}i", raw, 0)[0] != 348 or raw[344:347] not in (b"n+1", b"ni1"):
        raise ValueError("not a NIfTI-1 file")
    dim = struct.unpack_from(f"{end}8h", raw, 40)
    intent, code = struct.unpack_from(f"{end}2h", raw, 68)
    pixdim = struct.unpack_from(f"{end}8f", raw, 76)
    offset, slope, inter = struct.unpack_from(f"{end}3f", raw, 108)
    qform, sform = struct.unpack_from(f"{end}2h", raw, 252)
    shape = dim[1 : dim[0] + 1]
    kind = np.dtype(end + NIFTI_TYPES[code])
    data = np.frombuffer(raw, kind, int(np.prod(shape)), int(offset)).reshape(shape, order="F")
    if slope not in (0.0, 1.0) or inter:
        data = data * (slope or 1.0) + inter
    m = np.eye(4)
    if sform > 0:
        m[:3] = np.array(struct.unpack_from(f"{end}12f", raw, 280)).reshape(3, 4)
    elif qform > 0:
        b, c, d, *shift = struct.unpack_from(f"{end}6f", raw, 256)
        a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
        turn = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
        m[:3, :3] = turn * (np.array(pixdim[1:4]) * [1, 1, -1 if pixdim[0] < 0 else 1])
        m[:3, 3] = shift
    else:
        m[:3, :3] = np.diag(pixdim[1:4])
    return np.asarray(data), m, {"intent": intent, "dim": shape, "datatype": code}


def write_nifti(data: np.ndarray, vox2ras: np.ndarray, intent: int = 0, compress: bool = False) -> bytes:
    code = next(k for k, v in NIFTI_TYPES.items() if np.dtype(v) == data.dtype)
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, data.ndim, *data.shape, *[1] * (7 - data.ndim))
    struct.pack_into("<3h", head, 68, intent, code, data.dtype.itemsize * 8)
    struct.pack_into("<8f", head, 76, 1, *np.linalg.norm(vox2ras[:3, :3], axis=0), 1, 1, 1, 1)
    struct.pack_into("<3f", head, 108, 352, 1, 0)
    head[123] = 2
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *np.asarray(vox2ras, float)[:3].reshape(-1))
    head[344:348] = b"n+1\0"
    raw = bytes(head) + data.tobytes(order="F")
    return gzip.compress(raw, mtime=0) if compress else raw


def write_warp(field: np.ndarray, vox2ras: np.ndarray, compress: bool = False) -> bytes:
    """A RAS displacement field (nx, ny, nz, 3) as a five-dimensional LPS vector image."""
    lps = field * np.array([-1.0, -1.0, 1.0])
    return write_nifti(lps[:, :, :, None, :].astype("f4"), vox2ras, VECTOR_INTENT, compress)


def read_warp(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    data, m, head = read_nifti(raw)
    if data.ndim != 5 or data.shape[3:] != (1, 3):
        raise ValueError("not a vector field")
    return data[:, :, :, 0, :].astype(float) * np.array([-1.0, -1.0, 1.0]), m


# ---------------------------------------------------------------- MATLAB level 4


def _variable(name: str, values: np.ndarray) -> bytes:
    raw = name.encode() + b"\0"
    return struct.pack("<5i", 0, values.size, 1, 0, len(raw)) + raw + values.astype("<f8").tobytes()


def read_variables(raw: bytes) -> dict[str, np.ndarray]:
    out, at = {}, 0
    while at < len(raw):
        if len(raw) - at < 20:
            raise ValueError("cut variable header")
        end = "<"
        kind, rows, cols, imag, size = struct.unpack_from("<5i", raw, at)
        if not 0 <= kind < 5000:
            end = ">"
            kind, rows, cols, imag, size = struct.unpack_from(">5i", raw, at)
        at += 20
        name = raw[at : at + size - 1].decode()
        at += size
        code = {0: "f8", 1: "f4", 2: "i4", 3: "i2", 4: "u2", 5: "u1"}[kind // 10 % 10]
        n = rows * cols
        if at + n * np.dtype(code).itemsize > len(raw):
            raise ValueError("cut variable")
        out[name] = np.frombuffer(raw, end + code, n, at).astype(float)
        at += n * np.dtype(code).itemsize * (2 if imag else 1)
    return out


def ras_lps(m: np.ndarray) -> np.ndarray:
    return RAS_TO_LPS @ m @ RAS_TO_LPS


def write_affine(m: np.ndarray, centre=(0.0, 0.0, 0.0)) -> bytes:
    """A RAS affine as the linear part, translation and fixed centre of an LPS transform."""
    lps, c = ras_lps(np.asarray(m, float)), np.asarray(centre, float) * [-1, -1, 1]
    shift = lps[:3, 3] - c + lps[:3, :3] @ c
    return _variable("AffineTransform_double_3_3", np.concatenate([lps[:3, :3].reshape(-1), shift])) + _variable("fixed", c)


def read_affine(raw: bytes) -> np.ndarray:
    v = read_variables(raw)
    p = next(x for k, x in v.items() if k != "fixed" and x.size == 12)
    c = v.get("fixed", np.zeros(3))
    lps = np.eye(4)
    lps[:3, :3] = p[:9].reshape(3, 3)
    lps[:3, 3] = p[9:] + c - lps[:3, :3] @ c
    return ras_lps(lps)


# ---------------------------------------------------------------- bundles


def _manifest_text(fields: dict) -> str:
    return "".join(f"{k}: {' '.join(map(str, v)) if isinstance(v, (list, tuple)) else v}\n" for k, v in fields.items())


def read_manifest(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in text.splitlines():
        if line[:1] in " \t" and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            out[last] = value.strip()
    return out


def save_registration(result: dict, folder: str, vox2ras: np.ndarray) -> str:
    """Affine, warps and a manifest in one folder; gives the manifest's path."""
    os.makedirs(folder, exist_ok=True)
    fields = {"Type": result["type"], "Affine": "affine.mat", "Reference": json.dumps(np.asarray(vox2ras).tolist())}
    with open(os.path.join(folder, "affine.mat"), "wb") as f:
        f.write(write_affine(result["transform"]))
    turn = np.asarray(vox2ras, float)[:3, :3]
    for name in ("forward", "inverse"):
        if name in result:
            fields[name.capitalize()] = f"{name}.nii.gz"
            with open(os.path.join(folder, f"{name}.nii.gz"), "wb") as f:
                f.write(write_warp(result[name] @ turn.T, vox2ras, True))
    path = os.path.join(folder, "manifest.dcf")
    with open(path, "w") as f:
        f.write(_manifest_text(fields))
    return path


def load_registration(path: str) -> dict:
    """From a manifest or its folder, or from a lone affine or warp file."""
    if path.endswith(".mat"):
        with open(path, "rb") as f:
            return {"type": "affine", "transform": read_affine(f.read())}
    if path.endswith((".nii", ".nii.gz")):
        with open(path, "rb") as f:
            field, m = read_warp(f.read())
        return {"type": "syn_only", "transform": np.eye(4), "forward_ras": field, "vox2ras": m}
    folder = path if os.path.isdir(path) else os.path.dirname(path)
    with open(os.path.join(folder, "manifest.dcf")) as f:
        fields = read_manifest(f.read())
    out: dict = {"type": fields["Type"], "vox2ras": np.array(json.loads(fields["Reference"]))}
    with open(os.path.join(folder, fields["Affine"]), "rb") as f:
        out["transform"] = read_affine(f.read())
    for name in ("Forward", "Inverse"):
        if name in fields:
            with open(os.path.join(folder, fields[name]), "rb") as f:
                out[f"{name.lower()}_ras"] = read_warp(f.read())[0]
    return out
