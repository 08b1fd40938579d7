"""What other implementations of the formats agree on. Names and numbers of formats stand in fixed_values.json."""

import json
from pathlib import Path

_FIXED = json.loads(Path(__file__).with_name("fixed_values.json").read_text())

#: Domains of the hashes, each followed by a zero byte.
SEMANTIC_DOMAIN, ENCODING_DOMAIN, TASK_DOMAIN, RESULT_DOMAIN = (_FIXED["domains"][k] for k in ("semantic", "encoding", "task", "result"))

#: Profiles and formats by number.
PROFILES: dict[str, int] = _FIXED["profiles"]
FORMATS: dict[str, int] = _FIXED["formats"]
ACCOUNT, LEGACY, FORGED, MACHINE, COMPACT = FORMATS

#: How payloads, texts and envelopes begin.
COMPACT_MAGIC, COMPACT_TEXT, LEGACY_TEXT, ACCOUNT_MAGIC, FORGED_TEXT, MACHINE_MAGIC = "NC4P", "NCM4P:", "NCM3:", "NCBK", "NCF1.", "NCPV"
TASK_MAGIC, RESULT_MAGIC = "NCPT", "NCPR"
#: In the order in which they are tried.
BEGINNINGS = ((COMPACT_MAGIC, COMPACT), (COMPACT_TEXT, COMPACT), (LEGACY_TEXT, LEGACY), (ACCOUNT_MAGIC, ACCOUNT), (FORGED_TEXT, FORGED), (MACHINE_MAGIC, MACHINE))

#: Grids: terrain x, y, z; forge x, y, z.
TERRAIN_GRID = (16, 512, 16)
FORGE_GRID = (14, 10, 14)

#: Default and absolute ceilings.
LIMITS = {
    "max_input_bytes": (1 << 20, 4 << 20), "max_commands": (4096, 16384), "max_materials": (4096, 8192), "max_patches": (131072, 262144),
    "max_voxels": (131072, 262144), "max_writes": (262144, 1048576), "max_decode_units": (2_000_000, 8_000_000), "max_memory_bytes": (64 << 20, 256 << 20),
    "max_op_expansion": (131072, 262144),
}

#: Compact opcodes and residual tags.
OPCODES = ("box", "repeat_box", "gable", "tree", "fence", "run", "wall", "extrude", "translate", "rotate_y", "mirror", "repeat_region", "clear_box")
RESIDUALS = ("none", "sparse", "runs", "boxes", "layers", "xor", "groups")
GABLE_STYLES = ("outline", "trim", "fill")

#: Default colours of forge resources.
RESOURCE_COLOURS = (0x9AA, 0xB64, 0xCCB, 0x332, 0x753, 0xEDC)
