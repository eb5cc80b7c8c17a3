"""Fixed names of the data model and column groups."""

from __future__ import annotations

#: Activity ids and names of the recordings; 0 marks transient rows.
ACTIVITIES = {
    0: "other_transient", 1: "lying", 2: "sitting", 3: "standing", 4: "walking", 5: "running", 6: "cycling", 7: "nordic_walking", 9: "watching_tv", 10: "computer_work",
    11: "car_driving", 12: "ascending_stairs", 13: "descending_stairs", 16: "vacuum_cleaning", 17: "ironing", 18: "folding_laundry", 19: "house_cleaning", 20: "playing_soccer", 24: "rope_jumping",
}
LOCATIONS = ("hand", "chest", "ankle")
#: The columns of one sensor location, in file order.
SENSOR = ("temperature", "acc_16g_x", "acc_16g_y", "acc_16g_z", "acc_6g_x", "acc_6g_y", "acc_6g_z", "gyro_x", "gyro_y", "gyro_z", "mag_x", "mag_y", "mag_z", "orientation_q1", "orientation_q2", "orientation_q3", "orientation_q4")
RAW_COLUMNS = ("timestamp", "activity_id", "heart_rate", *(f"{place}_{name}" for place in LOCATIONS for name in SENSOR))
DEFAULT_CHANNELS = tuple(f"{place}_{kind}_{axis}" for place in LOCATIONS for kind in ("acc_16g", "gyro") for axis in "xyz")
IDS = ("window_id", "subject_id", "activity_id", "activity_name")
OVERALL = "overall_mean"


def value_columns(columns) -> list[str]:
    """Embedding columns, found by their prefix."""
    return [c for c in columns if c.startswith("value_")]
