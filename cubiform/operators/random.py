"""Numbers of a search: a stream cipher seeded by (seed, stream, generation), so that draws do not depend on who makes them."""

from __future__ import annotations

_M64 = (1 << 64) - 1
_M32 = (1 << 32) - 1
#: The last blocks: searches of one seed draw the same ones for every target.
_BLOCKS: dict[tuple[int, ...], list[int]] = {}


def splitmix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _M64
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & _M64
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & _M64
    return x ^ x >> 31


class ChaCha8:
    """The ChaCha stream cipher with eight rounds, as a source of numbers."""

    def __init__(self, key: bytes):
        self.key = [int.from_bytes(key[i : i + 4], "little") for i in range(0, 32, 4)]
        self.block, self.words = 0, []

    @classmethod
    def seeded(cls, seed: int, stream: int, generation: int) -> ChaCha8:
        state = seed ^ stream * 0x9E3779B97F4A7C15 & _M64 ^ generation * 0xBF58476D1CE4E5B9 & _M64
        key = b""
        for _ in range(4):
            state = splitmix(state)
            key += state.to_bytes(8, "little")
        return cls(key)

    def _made(self) -> list[int]:
        start = [0x61707865, 0x3320646E, 0x79622D32, 0x6B206574, *self.key, self.block & _M32, self.block >> 32, 0, 0]
        s = start[:]

        def quarter(a, b, c, d):
            for x, y, z, n in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
                s[x] = s[x] + s[y] & _M32
                v = s[z] ^ s[x]
                s[z] = (v << n | v >> 32 - n) & _M32

        for _ in range(4):
            for i in range(4):
                quarter(i, 4 + i, 8 + i, 12 + i)
            for i in range(4):
                quarter(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4)
        return [a + b & _M32 for a, b in zip(s, start)][::-1]

    def _fill(self) -> None:
        at = (*self.key, self.block)
        if at not in _BLOCKS:
            if len(_BLOCKS) >= 1 << 10:
                _BLOCKS.clear()
            _BLOCKS[at] = self._made()
        self.words = list(_BLOCKS[at])
        self.block += 1

    def u32(self) -> int:
        if not self.words:
            self._fill()
        return self.words.pop()

    def u64(self) -> int:
        return self.u32() | self.u32() << 32

    def below(self, n: int) -> int:
        """0 without a draw where there is no choice."""
        return self.u64() % n if n > 1 else 0
