"""Published residue properties, name tables and thresholds.

Everything in this module is data.  The column expressions that use it live in
the sibling modules.
"""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------
# Three-letter residue name -> one-letter code.
THREE_TO_ONE = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C",
    "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P",
    "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}
ONE_TO_THREE = {one: three for three, one in THREE_TO_ONE.items()}
CANONICAL_AA = tuple(sorted(ONE_TO_THREE))
# Modified residues treated as a standard one.
MODIFIED_RESIDUES = {"MSE": "MET"}

# Electronegativity shift (eV) and steric index per amino acid.
ELECTRONEGATIVITY = {
    "A": 0.0, "R": 0.2, "N": -0.2, "D": -0.3, "C": -0.8,
    "Q": -0.2, "E": -0.3, "G": 0.0, "H": -0.1, "I": 0.1,
    "L": 0.1, "K": 0.2, "M": 0.0, "F": 0.2, "P": 0.0,
    "S": -0.1, "T": -0.1, "W": 0.3, "Y": 0.2, "V": 0.05,
}
# The display profile uses the same values but for cysteine.
ELECTRONEGATIVITY_DISPLAY = {**ELECTRONEGATIVITY, "C": -0.06}
STERIC_INDEX = {
    "A": 0.5, "R": 1.2, "N": 0.7, "D": 0.7, "C": 0.6,
    "Q": 0.8, "E": 0.8, "G": 0.4, "H": 0.9, "I": 1.0,
    "L": 1.0, "K": 1.1, "M": 0.9, "F": 1.2, "P": 0.8,
    "S": 0.6, "T": 0.7, "W": 1.3, "Y": 1.2, "V": 0.9,
}
# Approximate isoelectric point per amino acid.
ISOELECTRIC_POINT = {
    "A": 6.0, "R": 12.5, "N": 5.4, "D": 3.1, "C": 8.3,
    "Q": 5.7, "E": 2.2, "G": 5.5, "H": 6.0, "I": 6.0,
    "L": 6.0, "K": 10.5, "M": 5.7, "F": 5.5, "P": 6.3,
    "S": 5.7, "T": 5.6, "W": 5.9, "Y": 10.1, "V": 6.0,
}
DEFAULT_ISOELECTRIC_POINT = 6.5
DEFAULT_STERIC_INDEX = 0.7
HBOND_CAPABLE = ("S", "T", "N", "Q", "H", "D", "E", "K", "R", "Y")

# Substitution classes.
HYDROPHOBIC = ("A", "V", "I", "L", "M", "F", "Y", "W")
POLAR = ("S", "T", "N", "Q", "H")
CHARGED = ("K", "R", "D", "E")
SMALL = ("A", "G", "S")
AROMATIC = ("F", "Y", "W", "H")

# Partial charge and spin density of residues next to the cofactor.
NEIGHBOR_CHARGE = {
    "CYS": -0.30, "TRP": -0.10, "TYR": -0.05,
    "HIS": 0.02, "ASN": -0.02, "GLN": -0.02,
}
NEIGHBOR_SPIN = {
    "CYS": 0.60, "TRP": 0.40, "TYR": 0.30,
    "HIS": 0.20, "ASN": 0.15, "GLN": 0.15,
}
SCANNED_RESIDUES = ("CYS", "TRP", "TYR", "HIS", "ASN", "GLN")

# Electrostatic shift and vibrational damping of a substituted amino acid.
MUTATION_ELECTRO_SHIFT = {"C": -0.15, "F": 0.05, "Y": 0.04, "W": 0.03}
MUTATION_VIB_DAMPING = {"C": 1.10, "F": 0.95, "Y": 0.96, "W": 0.97}

# Electrons per element; any other element counts zero.
ELECTRONS = {
    "H": 1, "C": 6, "N": 7, "O": 8, "S": 16, "P": 15, "F": 9, "CL": 17,
}

# Residue names that form a cofactor site, and the type each name stands for.
COFACTOR_SITE_NAMES = ("FMN", "FAD", "RIB", "RBF")
COFACTOR_TYPE = {
    "FAD": "FAD", "FMN": "FMN", "RBF": "FMN", "RIB": "FMN", "FND": "FAD",
}
SCANNED_COFACTORS = ("FMN", "FAD")
ADENINE_NAMES = ("ADE", "ADN", "ADP", "AMP")

# Accession format of the protein sequence database.
ACCESSION_PATTERN = (
    r"^(?:[OPQ][0-9][A-Z0-9]{3}[0-9]"
    r"|[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){1,2})$"
)
RADICAL_PAIR_ACCESSIONS = ("P26484", "Q9VBW3")
FIXED_ACCESSION = "P26484"
CYSTEINE_SCALING = {"iso_scale": 0.85, "hb_scale": 0.9, "cross_scale": 0.9, "sulfur_shift": 0.8}

# Side-chain pseudo-atoms, offsets from the alpha carbon in angstrom.
SIDE_CHAIN_TEMPLATES = {
    "F": {"CB": (1.5, 0.0, 0.0), "CG": (2.5, 0.5, 0.5),
          "CD1": (3.6, 0.2, 0.2), "CD2": (3.6, 0.8, 0.8)},
    "W": {"CB": (1.5, 0.0, 0.0), "CG": (2.5, 0.6, 0.3),
          "CD1": (3.6, 0.2, 0.1), "CD2": (3.6, 1.0, 0.9)},
    "Y": {"CB": (1.5, 0.0, 0.0), "CG": (2.5, 0.4, 0.4),
          "CD1": (3.6, 0.1, 0.1), "CD2": (3.6, 0.7, 0.7),
          "OH": (4.5, 0.4, 0.4)},
    "H": {"CB": (1.5, 0.0, 0.0), "CG": (2.4, 0.3, 0.3),
          "ND1": (3.3, 0.1, 0.1), "CE1": (4.0, 0.2, 0.2)},
    "V": {"CB": (1.5, 0.0, 0.0), "CG1": (2.4, 0.5, 0.5),
          "CG2": (2.4, -0.5, -0.5)},
}
DEFAULT_SIDE_CHAIN = {"CB": (1.5, 0.0, 0.0)}
BACKBONE_ATOMS = ("N", "CA", "C", "O")

# Structures whose predictions are known to fail.
FAILURE_IDS = (
    "1CF3", "1IJH", "4MJW", "1UMK", "1NG4",
    "1VAO", "2GMJ", "1E0Y", "5K9B", "1HUV",
)

# Error thresholds in mV, model thresholds, and weights.
CHEMICAL_ACCURACY = 43.0
BENCHMARK_ACCURACY = 36.0
FAILURE_ERROR = 80.0
DIVERGENCE_ERROR = 150.0
WORST_MISSES = 54
ESCALATE_COMPLEXITY = 1.8
ESCALATE_SIGMA = 90.0
NUDGE_SMALL_TIER = 0.08
NUDGE_LARGE_TIER = 0.15
FARADAY = 96.485
MAE_LOCK = 46.5
MAE_REVERT = 46.0
CRITICAL_GAP = 0.01
CRITICAL_SPIN = 0.4
HIGH_HYPERFINE = 15.0
SULFUR_SHIFT = -0.03
BASE_GAP_EV = 0.35
BASE_BRIGHTNESS = 150.0
TRAINING_MEAN_EM = -208.30234375

# Search settings and score weights of the recommender.
PRIMARY_RADIUS = 8.0
SECONDARY_RADIUS = 12.0
MAX_COMBO_SIZE = 3
BEAM_WIDTH = 6
TOP_N = 5
SITE_SUBSTITUTIONS = 3
NEAREST_FALLBACK = 24
CLASH_WEIGHT = 0.5
STABILITY_WEIGHT = 0.7
CONFIDENCE_WEIGHT = 0.3
SYNERGY_WEIGHT = 0.2
SECOND_SHELL_PENALTY = 0.35

# Tolerances of the variant audit.
ABSOLUTE_TOLERANCE = 1e-3
RELATIVE_TOLERANCE = 0.02
EMISSION_TOLERANCE = 1e-3
