"""Platform profiles: what a device log looks like, as plain values; and their registry."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

SEVERITIES = ("critical", "warning", "info")
KINDS = ("pattern", "timeout", "sequence")
TIMESTAMP = r"^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3})\]"


@dataclass(frozen=True)
class Channel:
    name: str
    patterns: tuple[str, ...]
    is_regex: bool = False


@dataclass(frozen=True)
class Milestone:
    name: str
    pattern: str
    order: int
    is_regex: bool = False


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    severity: str
    kind: str = "pattern"
    pattern: str = ""
    is_regex: bool = False
    sigma: float | None = None  # None: the analysis's own
    pair: str = ""
    required: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.severity not in SEVERITIES or self.kind not in KINDS:
            raise ValueError(f"{self.rule_id}: severity is one of {SEVERITIES}, kind of {KINDS}")


@dataclass(frozen=True)
class MinerOptions:
    similarity: float = 0.4
    depth: int = 4
    max_clusters: int = 1024
    max_children: int = 100
    delimiters: tuple[str, ...] = (":", "=", "|")


@dataclass(frozen=True)
class Profile:
    name: str
    title: str
    anchors: tuple[str, ...]
    fallback_anchors: tuple[str, ...] = ()
    timestamp: str | None = TIMESTAMP
    milestones: tuple[Milestone, ...] = ()
    processes: tuple[tuple[str, str], ...] = ()
    channels: tuple[Channel, ...] = ()
    rules: tuple[Rule, ...] = ()
    miner: MinerOptions = field(default_factory=MinerOptions)
    detect: tuple[str, ...] = ()

    @property
    def has_time(self) -> bool:
        return self.timestamp is not None


def _milestones(rows: Sequence[tuple[str, str]]) -> tuple[Milestone, ...]:
    return tuple(Milestone(name, pattern, i) for i, (name, pattern) in enumerate(rows, 1))


# Anchors, milestones, processes, channels, rules and detection marks of the two known platforms.
_ANCHORS, _FALLBACK = ("U-Boot TPL",), ("Starting kernel", "Booting Linux")

BASE_RULES = (
    Rule("kernel_panic", "Kernel Panic", "critical", pattern="Kernel panic"),
    Rule("oom_killer", "OOM Killer", "critical", pattern="Out of memory"),
    Rule("oops", "Kernel Oops", "critical", pattern="Oops:"),
    Rule("segfault", "Segmentation Fault", "critical", pattern="segfault"),
    Rule("watchdog_reset", "Watchdog Reset", "warning", pattern="watchdog.*reset", is_regex=True),
)

BDK = Profile(
    "bdk", "BDK (BGW720-300)", _ANCHORS, _FALLBACK,
    milestones=_milestones([
        ("tpl_start", "U-Boot TPL"), ("uboot_main", "U-Boot 2024"), ("watchdog_start", "WDT:   Started watchdog"), ("kernel_start", "Starting kernel"),
        ("linux_boot", "Booting Linux on physical CPU"), ("rpc_tunnel_done", "Init complete for FIFO tunnel"), ("pcie_link_up", "bcm-pcie: Core"),
        ("network_config", "Configuring networking"), ("enet_ready", "wait_enet_ready done"), ("wifi_fw_load", "dhd_bus_start_try download fw"),
    ]),
    processes=(
        ("U-Boot TPL", "U-Boot TPL"), ("U-Boot Main", "U-Boot 2024"), ("Kernel Start", "Starting kernel"), ("Linux Boot", "Booting Linux on physical CPU"),
        ("SMCOS", "SMCOS:"), ("RPC Tunnel", "Init complete for FIFO tunnel"), ("Flow Cache", "fcache"), ("PCIe Link UP", "Link UP"),
        ("Networking Config", "Configuring networking"), ("WiFi wl0", "wl0:"), ("Enet Ready", "wait_enet_ready done"), ("DHD FW Load", "dhd_bus_start_try download fw"),
        ("Offload (dol0)", "dol0:"), ("SBF", "SBF:"), ("WiFi wl1", "wl1:"), ("WiFi wl2", "wl2:"), ("ACS Daemon", "acsd:"),
    ),
    channels=(
        Channel("wifi", ("wl0", "wl1", "wl2", "CFG80211", "acsd")), Channel("dhd", ("dhd.*", "dhdpcie.*"), True), Channel("rpc", ("RPC", "ARMTF RPC")),
        Channel("pcie", ("bcm-pcie", r"pci\s"), True), Channel("network", ("tc_netdev.*", "br0", "NET", "IPv6", "e1000e", "ixgbe"), True),
        Channel("kernel", ("SMCOS", "SBF", "printk", "kfence")), Channel("offload", ("dol0", "dol1", "dol2", "fcache")),
    ),
    detect=("acsd:", "wait_enet_ready done", "dhd_bus_start_try download fw", "Configuring networking", "SBF:"),
)

PRPLOS = Profile(
    "prplos", "prplOS (BGW720-300)", _ANCHORS, _FALLBACK, timestamp=None,
    milestones=_milestones([
        ("smc_bootloader", "SMC bootloader"), ("smc_os_loaded", "SMC OS loaded successfully"), ("smcos_start", "SMCOS: starting core services"),
        ("tpl_start", "U-Boot TPL"), ("uboot_main", "U-Boot 2024"), ("watchdog_start", "WDT:   Started watchdog"), ("kernel_start", "Starting kernel"),
        ("linux_boot", "Booting Linux on physical CPU"), ("rpc_tunnel_done", "Init complete for FIFO tunnel"), ("procd_early", "procd: - early -"),
        ("procd_ubus", "procd: - ubus -"), ("procd_init", "procd: - init -"), ("kmodloader", "kmodloader: done loading"), ("pcie_link_up", "bcm-pcie: Core"),
        ("wlan_modules", "loading WLAN kernel modules"), ("wifi_wl0_init", "wl0: creating kthread"), ("wifi_wl1_init", "wl1: creating kthread"), ("wifi_wl2_init", "wl2: creating kthread"),
    ]),
    processes=(
        ("SMC Bootloader", "SMC bootloader"), ("SMC OS", "SMC OS loaded"), ("SMCOS Services", "SMCOS: starting core services"), ("U-Boot TPL", "U-Boot TPL"),
        ("U-Boot Main", "U-Boot 2024"), ("Kernel Start", "Starting kernel"), ("Linux Boot", "Booting Linux on physical CPU"), ("RPC Tunnel", "Init complete for FIFO tunnel"),
        ("procd early", "procd: - early -"), ("procd ubus", "procd: - ubus -"), ("procd init", "procd: - init -"), ("kmodloader", "kmodloader: done loading"),
        ("PCIe Link UP", "bcm-pcie: Core"), ("WLAN Modules", "loading WLAN kernel modules"), ("WiFi wl0", "wl0: creating kthread"), ("WiFi wl1", "wl1: creating kthread"), ("WiFi wl2", "wl2: creating kthread"),
    ),
    channels=(
        Channel("wifi", ("wl0", "wl1", "wl2", "CFG80211")), Channel("dhd", ("dhd.*", "dhdpcie.*"), True), Channel("rpc", ("RPC", "ARMTF RPC")),
        Channel("pcie", ("bcm-pcie", r"pci\s"), True), Channel("procd", ("procd:", "ubusd", "netifd")), Channel("tr181", ("tr181-.*",), True),
        Channel("kernel", ("SMCOS", "kmodloader", "printk", "kfence")), Channel("network", ("tc_netdev.*", "br0", "NET", "IPv6"), True), Channel("offload", ("dol0", "dol1", "dol2", "fcache")),
    ),
    rules=(
        Rule("boot_timeout", "Boot Timeout", "critical", pattern="Boot timeout"),
        Rule("phy_lookup_failed", "PHY Lookup Failed", "warning", pattern="Failed to find phy for port"),
        Rule("overlayfs_inode_failure", "OverlayFS Inode Failure", "critical", pattern="overlayfs: failed to get inode"),
        Rule("gpio_probe_failed", "GPIO Expander Probe Failed", "warning", pattern="pca953x: probe of"),
        Rule("watchdog_device_busy", "Watchdog Device Busy", "warning", pattern="Could not open /dev/watchdog"),
        Rule("regulatory_db_missing", "Regulatory DB Missing", "warning", pattern="failed to load regulatory.db"),
        Rule("cfg80211_error", "CFG80211 Error", "warning", pattern="CFG80211-ERROR"),
        Rule("fatal_signal", "Unexpected Fatal Signal", "critical", pattern="potentially unexpected fatal signal"),
    ),
    detect=("procd: - ubus -", "procd: - init -", "kmodloader:", "prplOS", "root@prplOS"),
)

_registry: dict[str, Profile] = {}


def register(profile: Profile) -> Profile:
    _registry[profile.name] = profile
    return profile


def get(name: str) -> Profile:
    if name not in _registry:
        raise KeyError(f"no platform {name!r}; known: {', '.join(_registry)}")
    return _registry[name]


def registered() -> list[Profile]:
    return list(_registry.values())


register(BDK)
register(PRPLOS)
