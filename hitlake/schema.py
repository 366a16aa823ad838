"""Schemas and fixed values of the detector and its readout."""

from __future__ import annotations

HIT_COLUMNS = "fec vmm time ch adc adc_calibrated over_threshold offset bcid tdc timestamp_ns srs_timestamp abs_time_ns trigger_time trigger_counter hit_valid".split()
DERIVED = ["adc_calibrated", "timestamp_ns", "abs_time_ns", "hit_valid"]
RAW = [c for c in HIT_COLUMNS if c not in DERIVED]
KEY = ["capture_id", "pkt_no", "word_no"]

# Clock, converter and marker units in nanoseconds.
CLOCK_NS = 22.5
TAC_NS = 60.0
TDC_RANGE = 255
MARKER_NS = 25.0
BCID_PERIOD_NS = 4096 * CLOCK_NS

# Cabling. Station, z in mm, connector, hybrid, bottom VMM, top VMM.
CABLING = [
    ("P2_IN", 320.0, 4, 1, 2, 3),
    ("P2_IN", 320.0, 5, 2, 4, 5),
    ("P2_IN", 320.0, 6, 3, 6, 7),
    ("P2_MID", 630.0, 4, 4, 8, 9),
    ("P2_MID", 630.0, 5, 5, 10, 11),
    ("P2_MID", 630.0, 6, 6, 12, 13),
    ("P2_OUT", 940.0, 4, 7, 14, 15),
    ("P2_OUT", 940.0, 5, 8, 16, 17),
    ("P2_OUT", 940.0, 6, 9, 18, 19),
]
STATIONS = ["P2_IN", "P2_MID", "P2_OUT"]
STATION_VMMS = {s: [v for t, _, _, _, lo, hi in CABLING if t == s for v in (lo, hi)] for s in STATIONS}
TRIGGER = (0, 44)
NOISY_CHANNELS = [(4, 58), (7, 62)]
STRATEGIES = ["linear", "reverse", "pairswap"]
STRATEGY = "reverse"
BOTTOM_HALF = "bot"
OVERRIDES = {("P2_IN", 5, "top"): "linear", ("P2_IN", 6, "top"): "linear"}
# Card and channel of each station's supplies.
SUPPLIES = [("P2_IN", "drift", "8", "0"), ("P2_IN", "mesh", "8", "1"), ("P2_MID", "drift", "8", "2"), ("P2_MID", "mesh", "8", "3"), ("P2_OUT", "drift", "8", "4"), ("P2_OUT", "mesh", "8", "5")]

DEAD_NS = 1500.0
Z_68 = 0.9944578832097535

PACKETS = "capture_id string, pkt_no long, src_ip string, dst_ip string, payload binary"
EFFICIENCY_FIELDS = ["efficiency", "efficiency_lo", "efficiency_hi", "raw_efficiency", "accidental_efficiency", "mu_ns", "sigma_ns", "contrast"]
CALIBRATION = "vmm int, ch int, time_offset double, time_slope double, adc_offset double, adc_slope double"
PAD_FIELDS = ["pad_cx", "pad_cy", "radius", "phi", "pad_w", "pad_h", "pad_angle", "delta_phi"]
