"""Registry of decoders, and the contract that they keep.

A decoder opens a file inside a task, never on the driver.  Frames are (height, width, 3) uint8
RGB; ranges are [start, stop).  Codecs aren't part of this engine: the adapters load a library if
an executor has it and say so if not.  None of the four libraries was at hand when they were
written, so the adapters are untested against them; the built-in ``npy`` decoder (a (frames,
height, width, 3) array) is tested and shows the contract.
"""

from __future__ import annotations

import importlib
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np

AUTO = ("torchcodec", "decord", "pyav", "opencv")  #: order in which ``auto`` tries them


class DecoderNotAvailable(RuntimeError):
    """The library that a decoder needs isn't installed."""


class Decoder(ABC):
    fps: float = 30.0
    num_frames: int = 0
    width: int = 0
    height: int = 0
    codec: str = "unknown"
    device: str = "cpu"  #: for those that can decode elsewhere: cuda, cuda:1

    @abstractmethod
    def open(self, path: str) -> None: ...

    @abstractmethod
    def read_frame(self, i: int) -> np.ndarray: ...

    def close(self) -> None:
        """Release what open() took."""

    def checked(self, i: int) -> int:
        if not 0 <= i < self.num_frames:
            raise IndexError(f"frame {i} of {self.num_frames}")
        return i

    def read_clip(self, start: int, stop: int) -> Iterator[np.ndarray]:
        if start < 0 or stop > self.num_frames or start >= stop:
            raise IndexError(f"clip [{start}, {stop}) of {self.num_frames} frames")
        return (self.read_frame(i) for i in range(start, stop))

    def seek(self, ts: float) -> int:
        return max(0, min(int(ts * self.fps), self.num_frames - 1))

    def __enter__(self) -> Decoder:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def _library(name: str):
    try:
        return importlib.import_module(name)
    except ImportError as e:
        raise DecoderNotAvailable(f"{name} is not installed") from e


class Npy(Decoder):
    codec = "raw"

    def open(self, path: str) -> None:
        self.data = np.load(path, mmap_mode="r")
        self.num_frames, self.height, self.width = self.data.shape[:3]

    def read_frame(self, i: int) -> np.ndarray:
        return np.ascontiguousarray(self.data[self.checked(i)])


class OpenCv(Decoder):
    def open(self, path: str) -> None:
        self.cv = _library("cv2")
        self.cap = self.cv.VideoCapture(path)
        get = lambda k: self.cap.get(getattr(self.cv, f"CAP_PROP_{k}"))
        self.fps, self.num_frames, self.width, self.height = get("FPS"), int(get("FRAME_COUNT")), int(get("FRAME_WIDTH")), int(get("FRAME_HEIGHT"))
        code = int(get("FOURCC"))
        self.codec = "".join(chr((code >> 8 * k) & 255) for k in range(4))

    def read_frame(self, i: int) -> np.ndarray:
        self.cap.set(self.cv.CAP_PROP_POS_FRAMES, self.checked(i))
        ok, frame = self.cap.read()
        if not ok:
            raise IndexError(f"frame {i} can't be decoded")
        return np.ascontiguousarray(frame[:, :, ::-1])  # BGR

    def close(self) -> None:
        self.cap.release()


class Decord(Decoder):
    def open(self, path: str) -> None:
        lib = _library("decord")
        kind, _, number = self.device.partition(":")
        self.reader = lib.VideoReader(path, ctx=lib.cpu(0) if kind == "cpu" else lib.gpu(int(number or 0)))
        self.num_frames, self.fps = len(self.reader), float(self.reader.get_avg_fps())
        if self.num_frames:
            self.height, self.width = self.reader[0].shape[:2]

    def read_frame(self, i: int) -> np.ndarray:
        return self.reader[self.checked(i)].asnumpy()


class TorchCodec(Decoder):
    def open(self, path: str) -> None:
        self.reader = _library("torchcodec.decoders").VideoDecoder(path, device=self.device)
        m = self.reader.metadata
        self.num_frames, self.fps, self.width, self.height, self.codec = m.num_frames, m.average_fps, m.width, m.height, m.codec

    def read_frame(self, i: int) -> np.ndarray:
        return self.reader[self.checked(i)].permute(1, 2, 0).cpu().numpy()


class PyAv(Decoder):
    def open(self, path: str) -> None:
        self.box = _library("av").open(path)
        self.stream = self.box.streams.video[0]
        self.fps, self.num_frames = float(self.stream.average_rate), self.stream.frames
        self.width, self.height, self.codec = self.stream.width, self.stream.height, self.stream.codec_context.name
        if not self.num_frames and self.stream.duration:
            self.num_frames = int(self.stream.duration * self.stream.time_base * self.fps)

    def read_frame(self, i: int) -> np.ndarray:
        base, rate = self.stream.time_base, self.stream.average_rate
        want = int(self.checked(i) / (base * rate))
        self.box.seek(want, stream=self.stream)
        for frame in self.box.decode(self.stream):
            if frame.pts is not None and frame.pts >= want:
                return frame.to_ndarray(format="rgb24")
        raise IndexError(f"frame {i} can't be decoded")

    def close(self) -> None:
        self.box.close()


DECODERS: dict[str, Callable[[], Decoder]] = {"npy": Npy, "opencv": OpenCv, "decord": Decord, "torchcodec": TorchCodec, "pyav": PyAv}


def register(name: str, make: Callable[[], Decoder]) -> None:
    DECODERS[name] = make


def check_name(name: str) -> str:
    if name != "auto" and name not in DECODERS:
        raise ValueError(f"unknown decoder {name!r}; there are {sorted(DECODERS)} and auto")
    return name


def opened(path: str, name: str = "auto", device: str = "cpu") -> Decoder:
    """An open decoder; ``auto`` passes over those whose library is missing.  Only torchcodec and decord heed the device."""
    check_name(name)
    for one in (["npy"] if path.endswith(".npy") else list(AUTO)) if name == "auto" else [name]:
        decoder = DECODERS[one]()
        decoder.device = device
        try:
            decoder.open(path)
            return decoder
        except DecoderNotAvailable:
            if name != "auto":
                raise
    raise DecoderNotAvailable(f"no decoder for {path}")
