"""Default vocabularies.

Fixed values: every table here must equal the established vocabulary for
results to agree, so the entries are stated plainly and in natural order.
All are small constants, never data, so operators may inline or broadcast them.
"""

from __future__ import annotations

# The 16 columns of the long measurement table.
MEASUREMENT_COLUMNS = [
    "CID", "InChIKey", "PubChemName", "PubChem_URL", "Source", "Section", "Subsection",
    "PropertyName", "PropertyValue", "PropertyUnit", "Reference", "Method", "Comment",
    "Condition", "ReactionEquation", "SourceURL",
]

# Identity columns of the wide table.
IDENTITY_COLUMNS = ["CID", "InChIKey", "PubChemName", "PubChem_URL"]

# Tokens read as null.
NULL_TOKENS = ["", "NA", "nan"]

# Columns that a long measurement file must have, and clue columns of look-alikes.
REQUIRED_COLUMNS = ["CID", "PropertyName", "PropertyValue"]
LOOKALIKE_COLUMNS = {
    "activity": ["assay_id", "target_name", "activity_value", "AID", "ChEMBL_ID"],
    "report": ["NIST_Found", "NIST_URL", "PubMed_Thermo_Count"],
    "wide": ["MW_Median", "Tb_Median", "Tm_Median", "LogP_Median"],
}

# Header words that leak in as property names.
ARTIFACT_NAMES = [
    "Quantity", "Value", "Units", "Phase change data", "Reaction data",
    "Gas phase ion energetics data", "Condensed phase thermochemistry data",
]

# Categories without numbers.
NON_QUANTITATIVE = [
    "Physical Description", "Color/Form", "Odor", "Taste", "Drugs", "Cosmetics",
    "Food Additives", "Fragrances", "Pesticides", "Dietary Ingredients",
    "Food Contact Substances", "Flavoring Agents", "Polymers", "Lipids", "Other Products",
    "Chemical Classes", "SpringerMaterials Properties",
]

# Patterns of values that are prose or references.
GARBAGE_PATTERNS = [r"For more", r"please visit", r"DOI:", r"\{'ExternalTableName'"]
URL_PATTERN = r"^\s*(https?://|www\.)"
DB_REFERENCE_PATTERN = r"^\s*[A-Za-z]{1,10}:\S+\s*$"

# Relations that mark a censored measurement.
CENSORED_RELATIONS = [">", "<", ">=", "<="]

# Property synonym -> standard name.
PROPERTY_SYNONYMS = {
    "molecular weight": "MW",
    "exact mass": "ExactMass",
    "monoisotopic mass": "MonoMass",
    "xlogp3": "LogP",
    "logp": "LogP",
    "boiling point": "Tb",
    "melting point": "Tm",
    "t boil": "Tb",
    "t fus": "Tm",
    "dissociation constants": "pKa",
    "ionization potential": "IE",
    "ie (ev)": "IE",
    "ea (ev)": "EA",
    "ae (ev)": "EA",
    "heat of vaporization": "Hvap",
    "Δ vap h° (kj/mol)": "Hvap",
    "Δ vap h (kj/mol)": "Hvap",
    "Δ fus h (kj/mol)": "Hfus",
    "Δ f h° gas (kj/mol)": "Hf_gas",
    "Δ f h° liquid (kj/mol)": "Hf_liq",
    "Δ f h° solid (kj/mol)": "Hf_sol",
    "proton affinity (kj/mol)": "PA",
    "gas basicity (kj/mol)": "GB",
    "collision cross section": "CCS",
}

# Unit spelling (lower case) -> unit. The square-angstrom key is
# lower case too, so that the spelling can actually be found.
UNIT_SPELLINGS = {
    "°c": "C",
    "c": "C",
    "k": "K",
    "kj/mol": "kJ/mol",
    "j/mol*k": "J/mol/K",
    "j/mol k": "J/mol/K",
    "j/mol/k": "J/mol/K",
    "j/mol": "J/mol",
    "ev": "eV",
    "da": "Da",
    "g/mol": "g/mol",
    "a2": "A2",
    "å²": "A2",
    "ang^2": "A2",
    "angstrom^2": "A2",
    "angstroms^2": "A2",
    "cm^3/mol": "cm^3/mol",
    "m^3/mol": "m^3/mol",
}

# Units looked for inside a value text, in order.
UNIT_CANDIDATES = [
    "°C", "K", "kJ/mol", "J/mol*K", "J/mol/K", "eV", "Da", "g/mol", "Å²", "A2", "cm^3/mol",
]

# Preferred property order of the wide table.
WIDE_ORDER = [
    "MW", "LogP", "Tm", "Tb", "Hvap", "Hfus", "Hf_gas", "Hf_liq", "Hf_sol", "PA", "GB",
    "IE", "EA", "CCS",
]

# Source priority, lower wins; others rank last.
SOURCE_PRIORITY = {"NIST": 1, "PubChem": 2}
OTHER_SOURCE_PRIORITY = 999

# Canonical unit of each managed property.
CANONICAL_UNITS = {
    "Tm": "K", "Tb": "K",
    "Hvap": "kJ/mol", "Hfus": "kJ/mol",
    "Hf_gas": "kJ/mol", "Hf_liq": "kJ/mol", "Hf_sol": "kJ/mol",
    "PA": "kJ/mol", "GB": "kJ/mol",
    "IE": "eV", "EA": "eV",
    "MW": "g/mol", "ExactMass": "g/mol", "MonoMass": "g/mol",
    "CCS": "A2",
}

# Fixed values: (unit, canonical unit) -> (divisor, offset); canonical = value / divisor + offset.
UNIT_CONVERSIONS = {
    ("C", "K"): (1.0, 273.15),
    ("K", "K"): (1.0, 0.0),
    ("J/mol", "kJ/mol"): (1000.0, 0.0),
    ("kJ/mol", "kJ/mol"): (1.0, 0.0),
    ("Da", "g/mol"): (1.0, 0.0),
    ("g/mol", "g/mol"): (1.0, 0.0),
    ("eV", "eV"): (1.0, 0.0),
    ("A2", "A2"): (1.0, 0.0),
}

# Plausible range of each property in canonical units.
PLAUSIBLE_RANGES = {
    "MW": (1.0, 2000.0), "ExactMass": (1.0, 2000.0), "MonoMass": (1.0, 2000.0),
    "Tm": (1.0, 1500.0), "Tb": (1.0, 1500.0),
    "LogP": (-10.0, 15.0),
    "Hvap": (0.0, 500.0), "Hfus": (0.0, 300.0),
    "Hf_gas": (-2000.0, 2000.0), "Hf_liq": (-2000.0, 2000.0), "Hf_sol": (-2000.0, 2000.0),
    "PA": (0.0, 2000.0), "GB": (0.0, 2000.0),
    "IE": (1.0, 30.0), "EA": (-10.0, 10.0),
    "CCS": (10.0, 1000.0),
    "pKa": (-10.0, 50.0),
}

# Concentration unit spelling -> molar multiplier, and the prefixes of short units.
MOLAR_UNITS = {
    "pm": 1e-12, "pmol": 1e-12, "pmol/l": 1e-12,
    "nm": 1e-9, "nmol": 1e-9, "nmol/l": 1e-9,
    "um": 1e-6, "umol": 1e-6, "umol/l": 1e-6, "micromolar": 1e-6,
    "mm": 1e-3, "mmol": 1e-3, "mmol/l": 1e-3,
    "m": 1.0, "mol": 1.0, "mol/l": 1.0,
}
MOLAR_PREFIXES = {"p": 1e-12, "n": 1e-9, "u": 1e-6, "m": 1e-3}

# Physical constants.
HARTREE_TO_EV = 27.211386245988
HARTREE_TO_KCAL = 627.509474
HARTREE_TO_KJ = 2625.5
KCAL_TO_KJ = 4.184
REDOX_KJ_PER_EV = 96.5

# Target tokens of the general and of the stricter rule.
TARGET_TOKENS = ["ChEMBL:", "IC50", "EC50", "Ki", "Kd", "Potency"]
STRICT_TARGET_PREFIX = "ChEMBL:"
STRICT_TARGET_TOKENS = ["IC50", "EC50", " Ki", " Kd", "Potency"]

# Identifier columns never used as features.
MODEL_ID_COLUMNS = ["CID", "InChIKey", "PubChemName", "PubChem_URL", "SMILES"]

# Keyword families of target columns and the known property columns.
PROPERTY_FEATURES = [
    "MW", "LogP", "Tm", "Tb", "Hvap", "IE", "EA", "CCS", "ExactMass", "MonoMass", "Complexity",
    "Heavy Atom Count", "HBondDonorCount", "HBondAcceptorCount", "RotatableBondCount", "TPSA",
    "Rotatable Bond Count", "Formal Charge", "Isotope Atom Count",
    "Defined Atom Stereocenter Count", "Undefined Atom Stereocenter Count",
    "Covalently-Bonded Unit Count", "Hydrogen Bond Acceptor Count",
    "Hydrogen Bond Donor Count",
]
TARGET_FAMILIES = {
    "target_antimicrobial": [
        "Staphylococcus", "Escherichia", "Enterococcus", "Proteus", "Providencia",
        "Pseudomonas", "Klebsiella", "Salmonella", "Bacillus", "MIC", "MBC", "TIME",
    ],
    "target_antiparasitic": [
        "Leishmania", "Trypanosoma", "Plasmodium", "Giardia", "Trichomonas", "reductase",
        "oxidoreductase",
    ],
    "target_cytotoxicity": [
        "HepG2", "Vero", "THP-1", "CC50", "GI50", "CD50", "MCF7", "HeLa", "A549", "HCT",
    ],
}

# Feature list of the property-only trainer.
PROPERTY_ONLY_FEATURES = [
    "MW", "LogP", "Complexity", "Covalently-Bonded Unit Count",
    "Defined Atom Stereocenter Count", "Defined Bond Stereocenter Count", "ExactMass",
    "Formal Charge", "Heavy Atom Count", "Hydrogen Bond Acceptor Count",
    "Hydrogen Bond Donor Count", "Isotope Atom Count", "MonoMass", "Rotatable Bond Count",
    "Topological Polar Surface Area", "Undefined Atom Stereocenter Count",
    "Undefined Bond Stereocenter Count", "Solubility",
]

# The 13 descriptors of a frequency log and the 9 that have a state difference.
DESCRIPTORS = [
    "scf_energy", "zpe_correction", "thermal_corr_E", "thermal_corr_H", "thermal_corr_G",
    "E_plus_zpe", "enthalpy_H", "gibbs_G", "entropy_S", "temperature", "n_imaginary",
    "lowest_freq", "n_modes",
]
DELTA_DESCRIPTORS = [
    "scf_energy", "zpe_correction", "thermal_corr_E", "thermal_corr_H", "thermal_corr_G",
    "E_plus_zpe", "enthalpy_H", "gibbs_G", "entropy_S",
]
DESCRIPTOR_LABELS = {
    "zpe_correction": "Zero-point correction=",
    "thermal_corr_E": "Thermal correction to Energy=",
    "thermal_corr_H": "Thermal correction to Enthalpy=",
    "thermal_corr_G": "Thermal correction to Gibbs Free Energy=",
    "E_plus_zpe": "Sum of electronic and zero-point Energies=",
    "enthalpy_H": "Sum of electronic and thermal Enthalpies=",
    "gibbs_G": "Sum of electronic and thermal Free Energies=",
    "temperature": "Temperature",
}
TERMINATION_MARKER = "Normal termination"
ERROR_MARKER = "Error termination"

# Element symbols by atomic number 1..86; numbers without a name are left out.
ELEMENTS = {
    1: "H", 2: "He", 3: "Li", 4: "Be", 5: "B", 6: "C", 7: "N", 8: "O", 9: "F", 10: "Ne",
    11: "Na", 12: "Mg", 13: "Al", 14: "Si", 15: "P", 16: "S", 17: "Cl", 18: "Ar", 19: "K",
    20: "Ca", 21: "Sc", 22: "Ti", 23: "V", 24: "Cr", 25: "Mn", 26: "Fe", 27: "Co", 28: "Ni",
    29: "Cu", 30: "Zn", 31: "Ga", 32: "Ge", 33: "As", 34: "Se", 35: "Br", 36: "Kr", 37: "Rb",
    38: "Sr", 39: "Y", 40: "Zr", 41: "Nb", 42: "Mo", 43: "Tc", 44: "Ru", 45: "Rh", 46: "Pd",
    47: "Ag", 48: "Cd", 49: "In", 50: "Sn", 51: "Sb", 52: "Te", 53: "I", 54: "Xe", 55: "Cs",
    56: "Ba", 57: "La", 72: "Hf", 73: "Ta", 74: "W", 75: "Re", 76: "Os", 77: "Ir", 78: "Pt",
    79: "Au", 80: "Hg", 81: "Tl", 82: "Pb", 83: "Bi", 84: "Po", 85: "At", 86: "Rn",
}

# Section headings of nested property payloads.
PROPERTY_HEADINGS = [
    "Computed Properties", "Chemical and Physical Properties", "Experimental Properties",
    "Chemical Classes",
]

# Page keywords, link topics, energy phrase, supplement words.
PAGE_KEYWORDS = [
    "Thermochemistry", "Thermodynamic", "Enthalpy", "Entropy", "Gibbs", "Heat of",
    "Heat Capacity", "Heat of Formation",
]
LINK_TOPICS = ["thermochemistry", "phase", "reaction", "ion energetics", "henry", "solubility"]
ENERGY_PHRASE = (
    r"(?i)((?:ΔH|Delta H|enthalpy|ΔS|Delta S|entropy|ΔG|Delta G|Gibbs free energy|free energy"
    r"|heat of formation|heat of combustion)[^\.\n]{0,120}?"
    r"[-+]?\d+(?:\.\d+)?\s*(?:kJ/mol|kJ mol-1|J/mol|J mol-1|kcal/mol|kcal mol-1"
    r"|cal/mol|cal mol-1|kcal per mol|kJ per mol))"
)
SUPPLEMENT_PATTERN = r"(?i)supplementary|supporting information|supplemental"
ACTIVITY_MENTION = r"(?i)(IC50|Ki|Kd|EC50)[\s:=]*([0-9,.]+)\s*(nM|uM|µM|mM|M|pM)?"

# Status words of batch jobs.
DONE_STATUSES = ["completed", "done", "success", "finished", "ok"]
FAILED_STATUSES = ["failed", "error", "aborted"]
