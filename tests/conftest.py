import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidymeter.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "tests", spark__sql__shuffle__partitions="4")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


def energy_line(value, cycles=9):
    return f" SCF Done:  E(RTEST) =  {value!r}  A.U. after {cycles} cycles"


def frequency_log(
    energies=(-154.01, -154.062345678),
    modes=((100.0, 200.0, 300.0), (400.0, 500.0, 600.0)),
    corrections=(("Zero-point correction", 0.123456), ("Thermal correction to Energy", 0.131234),
                 ("Thermal correction to Enthalpy", 0.132178), ("Thermal correction to Gibbs Free Energy", 0.098765)),
    sums=(("zero-point Energies", -154.123456), ("thermal Enthalpies", -154.11), ("thermal Free Energies", -154.15)),
    kelvin=298.15,
    table=(("Total", 55.5, 20.0, 75.0), ("Translational", 0.9, 3.0, 40.0), ("Rotational", 0.9, 3.0, 21.0), ("Vibrational", 53.7, 14.0, 14.0)),
):
    """A completed log with only the lines that the parsers read, from the values of FIXTURES.md."""
    lines = [energy_line(e) for e in energies]
    lines += [" Frequencies -- " + " ".join(f"{m:.2f}" for m in row) for row in modes]
    lines += [f" {label}= {value!r}" for label, value in corrections]
    lines += [f" Sum of electronic and {label}= {value!r}" for label, value in sums]
    lines += [f" Temperature {kelvin!r} Kelvin.", " E (Thermal) CV S"]
    lines += [" ".join(["", *map(str, row)]) for row in table]
    return "\n".join([*lines, "", " Normal termination", ""])


def step_log(steps=((-154.05, (0.01, 0.008, 0.04, 0.03)), (-154.062, (0.0004, 0.0001, 0.001, 0.0004)))):
    """An optimisation log: per step an energy and the four criteria against their thresholds."""
    labels = ("Maximum Force", "RMS     Force", "Maximum Displacement", "RMS     Displacement")
    limits = (0.00045, 0.0003, 0.0018, 0.0012)
    lines = []
    for energy, values in steps:
        lines.append(energy_line(energy))
        for label, value, limit in zip(labels, values, limits):
            lines.append(f" {label} {value:.6f} {limit:.6f} {'YES' if value <= limit else 'NO'}")
    return "\n".join([*lines, " Normal termination", ""])


@pytest.fixture
def freq_log():
    return frequency_log()


@pytest.fixture
def opt_log():
    return step_log()
