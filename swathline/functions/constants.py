"""Fixed values shared by the operators."""

from __future__ import annotations

# --- spectral bands, in stacking order -------------------------------------------------------
SPECTRAL_BANDS = ["blue", "green", "red", "red_edge", "nir"]
REFERENCE_BAND_ORDER = ["nir", "red_edge", "red", "green"]
INDEX_DEFS = {"ndvi": ("nir", "red"), "ndre": ("nir", "red_edge"), "gndvi": ("nir", "green")}

# --- nodata and raster defaults --------------------------------------------------------------
NODATA = -9999.0
POSE_NODATA = 0.0
TILE = 512
OVERVIEW_LEVELS = (2, 4, 8, 16)
MULTIRES_FACTORS = (2, 4, 8)
FEATHER_FRACTION = 0.30
METRES_PER_DEGREE = 111320.0

# --- files -----------------------------------------------------------------------------------
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "tif", "tiff", "dng"]
GROUND_TRUTH_FILES = [
    "gcps.csv", "gcp.csv", "ground_control_points.csv", "checkpoints.csv",
    "reference_reflectance.csv", "panel_values.csv", "spectral_reference.csv",
]
REFERENCE_PRODUCT_WORDS = ["orthomosaic", "ortho", "dsm", "dem", "ndvi", "hillshade", "reflectance"]
SENSOR_HINTS = {
    "sequoia": "Parrot Sequoia",
    "msp4c": "senseFly MSP4C",
    "slantrange": "SlantRange P3",
    "phantom4": "DJI Phantom 4 Multispectral",
    "p4m": "DJI Phantom 4 Multispectral",
    "altum": "MicaSense Altum",
    "rededge": "MicaSense RedEdge",
}

# --- image metadata property names -----------------------------------------------------------
DJI_PROPERTIES = [
    "BandName", "BandFreq", "SensorIndex", "DroneModel", "DroneSerialNumber", "CameraSerialNumber",
    "ImageSource", "Irradiance", "SensorGain", "ExposureTime", "BlackLevel", "SensorGainAdjustment",
    "CalibratedOpticalCenterX", "CalibratedOpticalCenterY", "VignettingData", "DewarpData",
    "CalibratedHMatrix", "CalibratedFocalLength", "GpsLatitude", "GpsLongitude", "AbsoluteAltitude",
    "RelativeAltitude",
]
MICASENSE_PROPERTIES = [
    "BandName", "CentralWavelength", "WavelengthFWHM", "BandSensitivity", "Irradiance",
    "IrradianceExposureTime", "IrradianceGain", "IrradianceYaw", "IrradiancePitch", "IrradianceRoll",
    "RigCameraIndex", "CaptureId", "FlightId", "PressureAlt", "BlackCurrent", "SunSensor",
    "SunSensorExposureTime",
]
EXTRA_PROPERTIES = [
    "FlightYawDegree", "GimbalYawDegree", "DewarpHMatrix", "RelativeOpticalCenterX",
    "RelativeOpticalCenterY", "VignettingPolynomial", "VignettingCenter", "ISOSpeed", "DarkRowValue",
    "BitsPerSample", "FocalLength",
]
ALL_PROPERTIES = list(dict.fromkeys(DJI_PROPERTIES + MICASENSE_PROPERTIES + EXTRA_PROPERTIES))

# --- band names and file suffixes ------------------------------------------------------------
DJI_BAND_NAMES = {
    "RGB": "rgb", "Wide": "rgb", "Visible": "rgb", "Red": "red", "Green": "green", "Blue": "blue",
    "NIR": "nir", "Near-Infrared": "nir", "RedEdge": "red_edge", "Red Edge": "red_edge",
    "Thermal": "thermal",
}
MICASENSE_BAND_NAMES = {
    "Blue": "blue", "Green": "green", "Red": "red", "Red edge": "red_edge", "RedEdge": "red_edge",
    "NIR": "nir", "Near-IR": "nir", "Near IR": "nir", "LWIR": "thermal", "Panchro": "panchromatic",
}
DJI_SUFFIXES = {
    "_D": "rgb", "_W": "rgb", "_T": "thermal", "_MS_G": "green", "_MS_R": "red", "_MS_RE": "red_edge",
    "_MS_NIR": "nir",
}
GENERIC_SUFFIXES = {
    "_GRE": "green", "_GRN": "green", "_RED": "red", "_REG": "red_edge", "_NIR": "nir", "_BLU": "blue",
    "_TIR": "thermal", "_PAN": "panchromatic", "_RGB": "rgb",
}
MICASENSE_NORMAL_NAMES = {
    "blue": "Blue", "green": "Green", "red": "Red", "red edge": "RedEdge", "rededge": "RedEdge",
    "nir": "NIR", "near-ir": "NIR", "near ir": "NIR", "lwir": "Thermal",
}
COLOUR_MODES = ["RGB", "RGBA", "YCbCr"]
SENSOR_FAMILY_RULES = [
    ("mavic 3m", "dji_mavic_3m"), ("m3m", "dji_mavic_3m"), ("mavic3m", "dji_mavic_3m"),
    ("p4 multispectral", "dji_p4_multispectral"), ("p4m", "dji_p4_multispectral"),
    ("phantom 4 multispectral", "dji_p4_multispectral"),
    ("phantom 4 rtk", "dji_phantom_4_rtk"), ("p4 rtk", "dji_phantom_4_rtk"),
    ("rededge", "micasense_rededge"), ("rededge-m", "micasense_rededge"),
    ("rededge-mx", "micasense_rededge"), ("altum", "micasense_altum"), ("altum-pt", "micasense_altum"),
]
MANUFACTURER_FAMILY = {"dji": "dji_mavic_3m", "micasense": "micasense_rededge", "parrot": "dji_mavic_3m"}

# --- camera field of view and height defaults ------------------------------------------------
DEFAULT_AGL_M = 30.0
DEFAULT_HFOV_DEG = 65.0
MODEL_HFOV_DEG = {"M3M": 38.5, "M3T": 82.9, "M30": 79.0, "P4M": 62.7}

# --- jobs ------------------------------------------------------------------------------------
STAGE_ORDER = [
    "pending", "queued", "radiometric_calibration", "sfm", "orthomosaic", "uploading", "publishing",
    "completed",
]
STAGE_PROGRESS = {
    "pending": 0.0, "queued": 0.0, "radiometric_calibration": 5.0, "sfm": 15.0, "orthomosaic": 60.0,
    "uploading": 90.0, "publishing": 95.0, "completed": 100.0, "failed": 0.0, "cancelled": 0.0,
}
STAGES = list(STAGE_PROGRESS)
TERMINAL = ["completed", "failed", "cancelled"]
ACTIVE_STATUSES = ["pending", "queued", "processing"]
STATE_TTL_HOURS = 72

# --- products --------------------------------------------------------------------------------
PRODUCT_LABELS = {
    "orthomosaic": "2D Orthomosaic",
    "dsm": "Digital Surface Model (DSM)",
    "dem": "Digital Elevation Model (DEM)",
    "hillshade": "Hillshade/Terrain Visualization",
    "pointcloud": "3D Point Cloud",
    "pointcloud_utm": "3D Point Cloud (UTM)",
    "mesh": "3D Mesh Model",
    "sparse_reconstruction": "Sparse Reconstruction",
    "dense_reconstruction": "Dense Reconstruction",
    "ndvi": "NDVI Map",
    "ndre": "NDRE Map",
    "gndvi": "GNDVI Map",
    "calibrated_reflectance": "Calibrated Reflectance",
    "band_manifest": "Band Classification Manifest",
    "orthomosaic_2x": "Orthomosaic 2× Downsample",
    "orthomosaic_4x": "Orthomosaic 4× Downsample",
    "orthomosaic_8x": "Orthomosaic 8× Downsample",
    "band_green": "Green Band Orthomosaic",
    "band_red": "Red Band Orthomosaic",
    "band_red_edge": "Red Edge Band Orthomosaic",
    "band_nir": "NIR Band Orthomosaic",
    "band_blue": "Blue Band Orthomosaic",
    "preview": "Preview/Thumbnail",
    "statistics": "Statistics/Metadata",
}
PRODUCT_TYPES = list(PRODUCT_LABELS)
PRODUCT_CATEGORIES = {
    "2D Raster": ["orthomosaic", "dsm", "dem", "hillshade", "orthomosaic_2x", "orthomosaic_4x",
                  "orthomosaic_8x"],
    "3D Model": ["pointcloud", "pointcloud_utm", "mesh"],
    "Reconstruction": ["sparse_reconstruction", "dense_reconstruction"],
    "Calibration": ["ndvi", "ndre", "gndvi", "calibrated_reflectance", "band_manifest", "band_green",
                    "band_red", "band_red_edge", "band_nir", "band_blue"],
}
EXPECTED_PRODUCTS = [
    "orthomosaic", "dsm", "pointcloud", "pointcloud_utm", "ndvi", "ndre", "gndvi",
    "calibrated_reflectance", "band_manifest", "band_green", "band_red", "band_red_edge", "band_nir",
    "band_blue",
]
MULTISPECTRAL_PRODUCTS = [
    "ndvi", "ndre", "gndvi", "calibrated_reflectance", "band_green", "band_red", "band_red_edge",
    "band_nir", "band_blue",
]
DOWNLOAD_ONLY_PRODUCTS = ["band_manifest", "statistics", "preview"]
CRITICAL_PRODUCTS = ["orthomosaic"]

# --- geodesy (WGS84) -------------------------------------------------------------------------
WGS84_A = 6378137.0
WGS84_E2 = 0.00669437999014
