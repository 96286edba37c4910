from faultline.functions.labels import bus_location, fault_code, normalised_label, phase_letters
from faultline.functions.vectors import (
    argmax_label,
    class_probabilities,
    distance_from_origin,
    ordered_steps,
    transposed,
)

__all__ = [
    "argmax_label",
    "bus_location",
    "class_probabilities",
    "distance_from_origin",
    "fault_code",
    "normalised_label",
    "ordered_steps",
    "phase_letters",
    "transposed",
]
