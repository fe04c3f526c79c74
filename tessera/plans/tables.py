"""Fixed tables of the encoder and the dimension tables made of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Base quantisation matrices by variant, in natural order; variant 1 is flat 16.
ANNEX_K_LUMA = (
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
)
MSSIM_LUMA = (
    12, 17, 20, 21, 30, 34, 56, 63,
    18, 20, 20, 26, 28, 51, 61, 55,
    19, 20, 21, 26, 33, 58, 69, 55,
    26, 26, 26, 30, 46, 87, 86, 66,
    31, 33, 36, 40, 46, 96, 100, 73,
    40, 35, 46, 62, 81, 100, 111, 91,
    46, 66, 76, 86, 102, 121, 120, 101,
    68, 90, 90, 96, 113, 102, 105, 103,
)
IMAGE_MAGICK_LUMA = (
    16, 16, 16, 18, 25, 37, 56, 85,
    16, 17, 20, 27, 34, 40, 53, 75,
    16, 20, 24, 31, 43, 62, 91, 135,
    18, 27, 31, 40, 53, 74, 106, 156,
    25, 34, 43, 53, 69, 94, 131, 189,
    37, 40, 62, 74, 94, 124, 169, 238,
    56, 53, 91, 106, 131, 169, 226, 311,
    85, 75, 135, 156, 189, 238, 311, 418,
)
PSNR_HVS_LUMA = (
    9, 10, 12, 14, 27, 32, 51, 62,
    11, 12, 14, 19, 27, 44, 59, 73,
    12, 14, 18, 25, 42, 59, 79, 78,
    17, 18, 25, 42, 61, 92, 87, 92,
    23, 28, 42, 75, 79, 112, 112, 99,
    40, 42, 59, 84, 88, 124, 132, 111,
    42, 64, 78, 95, 105, 126, 125, 99,
    70, 75, 100, 102, 116, 100, 107, 98,
)
KLEIN_LUMA = (
    10, 12, 14, 19, 26, 38, 57, 86,
    12, 18, 21, 28, 35, 41, 54, 76,
    14, 21, 25, 32, 44, 63, 92, 136,
    19, 28, 32, 41, 54, 75, 107, 157,
    26, 35, 44, 54, 70, 95, 132, 190,
    38, 41, 63, 75, 95, 125, 170, 239,
    57, 54, 92, 107, 132, 170, 227, 312,
    86, 76, 136, 157, 190, 239, 312, 419,
)
WATSON_LUMA = (
    7, 8, 10, 14, 23, 44, 95, 241,
    8, 8, 11, 15, 25, 47, 102, 255,
    10, 11, 13, 19, 31, 58, 127, 255,
    14, 15, 19, 27, 44, 83, 181, 255,
    23, 25, 31, 44, 72, 136, 255, 255,
    44, 47, 58, 83, 136, 255, 255, 255,
    95, 102, 127, 181, 255, 255, 255, 255,
    241, 255, 255, 255, 255, 255, 255, 255,
)
AHUMADA_LUMA = (
    15, 11, 11, 12, 15, 19, 25, 32,
    11, 13, 10, 10, 12, 15, 19, 24,
    11, 10, 14, 14, 16, 18, 22, 27,
    12, 10, 14, 18, 21, 24, 28, 33,
    15, 12, 16, 21, 26, 31, 36, 42,
    19, 15, 18, 24, 31, 38, 45, 53,
    25, 19, 22, 28, 36, 45, 55, 65,
    32, 24, 27, 33, 42, 53, 65, 77,
)
PETERSON_LUMA = (
    14, 10, 11, 14, 19, 25, 34, 45,
    10, 11, 11, 12, 15, 20, 26, 33,
    11, 11, 15, 18, 21, 25, 31, 38,
    14, 12, 18, 24, 28, 33, 39, 47,
    19, 15, 21, 28, 36, 43, 51, 59,
    25, 20, 25, 33, 43, 54, 64, 74,
    34, 26, 31, 39, 51, 64, 77, 91,
    45, 33, 38, 47, 59, 74, 91, 108,
)
ANNEX_K_CHROMA = (
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
)
MSSIM_CHROMA = (
    8, 12, 15, 15, 86, 96, 96, 98,
    13, 13, 15, 26, 90, 96, 99, 98,
    12, 15, 18, 96, 99, 99, 99, 99,
    17, 16, 90, 96, 99, 99, 99, 99,
    96, 96, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
)
PSNR_HVS_CHROMA = (
    9, 10, 17, 19, 62, 89, 91, 97,
    12, 13, 18, 29, 84, 91, 88, 98,
    14, 19, 29, 93, 95, 95, 98, 97,
    20, 26, 84, 88, 95, 95, 98, 94,
    26, 86, 91, 93, 97, 99, 98, 99,
    99, 100, 98, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    97, 97, 99, 99, 99, 99, 97, 99,
)

# Perceptual base matrices and frequency exponents, zero-bias multipliers and offsets, by component and natural order.
PERCEPTUAL_BASE = (
    1.2397409, 1.7227115, 2.9212167, 2.8127374, 3.3398197, 3.4636038, 3.8409152, 3.86956,
    1.7227115, 2.0928894, 2.845676, 2.7045068, 3.4407674, 3.1662324, 4.0252087, 4.0353245,
    2.9212167, 2.845676, 2.9587404, 3.386295, 3.6195238, 3.904628, 3.7578358, 4.2374475,
    2.8127374, 2.7045068, 3.386295, 3.3800588, 4.1679867, 4.8055106, 4.784259, 4.605934,
    3.3398197, 3.4407674, 3.6195238, 4.1679867, 4.5798513, 4.923237, 5.574107, 5.4853334,
    3.4636038, 3.1662324, 3.904628, 4.8055106, 4.923237, 5.43936, 5.0938957, 6.0872254,
    3.8409152, 4.0252087, 3.7578358, 4.784259, 5.574107, 5.0938957, 5.438461, 5.403736,
    3.86956, 4.0353245, 4.2374475, 4.605934, 5.4853334, 6.0872254, 5.403736, 4.377871,
    2.8236198, 6.4956394, 9.310489, 10.647479, 11.074191, 17.14639, 18.463982, 29.087002,
    6.4956394, 8.890104, 8.9768958, 13.66627, 16.547072, 16.638714, 26.778397, 21.330343,
    9.310489, 8.9768958, 11.087377, 18.205482, 19.752482, 23.98566, 102.64574, 24.450989,
    10.647479, 13.66627, 18.205482, 18.628012, 16.04251, 25.049183, 25.01714, 35.79789,
    11.074191, 16.547072, 19.752482, 16.04251, 19.373483, 14.67753, 19.94696, 51.094112,
    17.14639, 16.638714, 23.98566, 25.049183, 14.67753, 31.320412, 46.357234, 67.48111,
    18.463982, 26.778397, 102.64574, 25.01714, 19.94696, 46.357234, 61.315765, 88.34665,
    29.087002, 21.330343, 24.450989, 35.79789, 51.094112, 67.48111, 88.34665, 112.16099,
    2.9217255, 4.497681, 7.3563445, 6.5838915, 8.5356087, 8.7994344, 9.1883415, 9.4827,
    4.497681, 6.3095489, 7.024609, 7.1564453, 8.0490592, 7.012429, 6.7119232, 8.380308,
    7.3563445, 7.024609, 6.8921012, 6.88282, 8.782226, 6.877475, 7.8858176, 8.67909,
    6.5838915, 7.1564453, 6.88282, 7.003073, 7.7223465, 7.9554257, 7.473411, 8.362933,
    8.5356087, 8.0490592, 8.782226, 7.7223465, 6.7780059, 9.4849227, 9.0437027, 8.0531782,
    8.7994344, 7.012429, 6.877475, 7.9554257, 9.4849227, 8.6076065, 9.9226974, 64.25135,
    9.1883415, 6.7119232, 7.8858176, 7.473411, 9.0437027, 9.9226974, 63.184937, 83.35294,
    9.4827, 8.380308, 8.67909, 8.362933, 8.0531782, 64.25135, 83.35294, 114.89202,
)
FREQUENCY_EXPONENT = (
    1.0, 0.51, 0.67, 0.74, 1.0, 1.0, 1.0, 1.0,
    0.51, 0.66, 0.69, 0.87, 1.0, 1.0, 1.0, 1.0,
    0.67, 0.69, 0.84, 0.83, 0.96, 1.0, 1.0, 1.0,
    0.74, 0.87, 0.83, 1.0, 1.0, 0.91, 0.91, 1.0,
    1.0, 1.0, 0.96, 1.0, 1.0, 1.0, 1.0, 1.0,
    1.0, 1.0, 1.0, 0.91, 1.0, 1.0, 1.0, 1.0,
    1.0, 1.0, 1.0, 0.91, 1.0, 1.0, 1.0, 1.0,
    1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0,
)
ZERO_BIAS_LQ = (
    0.0, 0.0568, 0.388, 0.619, 0.619, 0.449, 0.449, 0.6187,
    0.0568, 0.5829, 0.6189, 0.619, 0.619, 0.719, 0.619, 0.6189,
    0.388, 0.6189, 0.619, 0.619, 0.619, 0.619, 0.6187, 0.61,
    0.619, 0.619, 0.619, 0.619, 0.589, 0.3839, 0.716, 0.619,
    0.619, 0.619, 0.619, 0.589, 0.619, 0.388, 0.586, 0.479,
    0.449, 0.719, 0.619, 0.3839, 0.388, 0.619, 0.619, 0.619,
    0.449, 0.619, 0.6187, 0.716, 0.586, 0.619, 0.6204, 0.619,
    0.6187, 0.6189, 0.61, 0.619, 0.479, 0.619, 0.619, 0.348,
    0.0, 1.164, 0.9373, 1.1319, 0.8016, 0.9136, 1.153, 0.943,
    1.164, 0.9188, 0.916, 1.198, 1.183, 0.9758, 0.943, 0.943,
    0.9373, 0.916, 0.843, 1.172, 0.7083, 0.943, 0.943, 0.943,
    1.1319, 1.198, 1.172, 1.149, 0.8547, 0.943, 0.943, 0.943,
    0.8016, 1.183, 0.7083, 0.8547, 0.943, 0.943, 0.943, 0.943,
    0.9136, 0.9758, 0.943, 0.943, 0.943, 0.943, 0.943, 0.943,
    1.153, 0.943, 0.943, 0.943, 0.943, 0.943, 0.943, 0.948,
    0.943, 0.943, 0.943, 0.943, 0.943, 0.943, 0.948, 0.943,
    0.0, 1.319, 0.4308, 0.446, 0.0661, 0.066, 0.266, 0.296,
    1.319, 0.328, 0.3093, 0.075, 0.0505, 0.1594, 0.306, 0.2113,
    0.4308, 0.3093, 0.306, 0.1182, 0.05, 0.306, 0.3915, 0.2426,
    0.446, 0.075, 0.1182, 0.0512, 0.05, 0.213, 0.393, 0.159,
    0.0661, 0.0505, 0.05, 0.05, 0.3055, 0.336, 0.5148, 0.5403,
    0.066, 0.1594, 0.306, 0.213, 0.336, 0.506, 0.5874, 0.306,
    0.266, 0.306, 0.3915, 0.393, 0.5148, 0.5874, 0.306, 0.306,
    0.296, 0.2113, 0.2426, 0.159, 0.5403, 0.306, 0.306, 0.306,
)
ZERO_BIAS_HQ = (
    0.0, 0.0044, 0.2521, 0.6547, 0.8161, 0.613, 0.8841, 0.8155,
    0.0044, 0.6831, 0.6553, 0.6295, 0.7848, 0.7843, 0.8474, 0.7836,
    0.2521, 0.6553, 0.7834, 0.7829, 0.8161, 0.8072, 0.7743, 0.9242,
    0.6547, 0.6295, 0.7829, 0.8654, 0.7829, 0.6986, 0.7818, 0.7726,
    0.8161, 0.7848, 0.8161, 0.7829, 0.7471, 0.7827, 0.7843, 0.7653,
    0.613, 0.7843, 0.8072, 0.6986, 0.7827, 0.7848, 0.9508, 0.7653,
    0.8841, 0.8474, 0.7743, 0.7818, 0.7843, 0.9508, 0.7839, 0.8437,
    0.8155, 0.7836, 0.9242, 0.7726, 0.7653, 0.7653, 0.8437, 0.7819,
    0.0, 1.0816, 1.0556, 1.2876, 1.1554, 1.1567, 1.8851, 0.5488,
    1.0816, 1.1537, 1.185, 1.0712, 1.1671, 2.0719, 1.0544, 1.4764,
    1.0556, 1.185, 1.287, 1.1981, 1.8181, 1.2618, 1.0564, 1.1191,
    1.2876, 1.0712, 1.1981, 1.4753, 2.0609, 1.0564, 1.2645, 1.0564,
    1.1554, 1.1671, 1.8181, 2.0609, 0.7324, 1.1163, 0.8464, 1.0564,
    1.1567, 2.0719, 1.2618, 1.0564, 1.1163, 1.004, 1.0564, 1.0564,
    1.8851, 1.0544, 1.0564, 1.2645, 0.8464, 1.0564, 1.0564, 1.0564,
    0.5488, 1.4764, 1.1191, 1.0564, 1.0564, 1.0564, 1.0564, 1.0564,
    0.0, 0.5392, 0.6659, 0.8968, 0.6829, 0.6328, 0.5802, 0.4836,
    0.5392, 0.6746, 0.676, 0.6102, 0.6015, 0.6958, 0.7327, 0.4897,
    0.6659, 0.676, 0.6957, 0.6543, 0.4396, 0.633, 0.7081, 0.2583,
    0.8968, 0.6102, 0.6543, 0.5913, 0.6457, 0.5828, 0.5139, 0.3565,
    0.6829, 0.6015, 0.4396, 0.6457, 0.5633, 0.4263, 0.6371, 0.5949,
    0.6328, 0.6958, 0.633, 0.5828, 0.4263, 0.2847, 0.2909, 0.6629,
    0.5802, 0.7327, 0.7081, 0.5139, 0.6371, 0.2909, 0.6644, 0.6644,
    0.4836, 0.4897, 0.2583, 0.3565, 0.5949, 0.6629, 0.6644, 0.6644,
)

# Standard Huffman tables, number of codes of each length from 1 and symbols in code order.
DC_LUMINANCE_BITS = (
    0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0,
)
DC_LUMINANCE_SYMBOLS = (
    0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11,
)
DC_CHROMINANCE_BITS = (
    0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0,
)
DC_CHROMINANCE_SYMBOLS = (
    0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11,
)
AC_LUMINANCE_BITS = (
    0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125,
)
AC_LUMINANCE_SYMBOLS = (
    1, 2, 3, 0, 4, 17, 5, 18, 33, 49, 65, 6, 19, 81, 97, 7,
    34, 113, 20, 50, 129, 145, 161, 8, 35, 66, 177, 193, 21, 82, 209, 240,
    36, 51, 98, 114, 130, 9, 10, 22, 23, 24, 25, 26, 37, 38, 39, 40,
    41, 42, 52, 53, 54, 55, 56, 57, 58, 67, 68, 69, 70, 71, 72, 73,
    74, 83, 84, 85, 86, 87, 88, 89, 90, 99, 100, 101, 102, 103, 104, 105,
    106, 115, 116, 117, 118, 119, 120, 121, 122, 131, 132, 133, 134, 135, 136, 137,
    138, 146, 147, 148, 149, 150, 151, 152, 153, 154, 162, 163, 164, 165, 166, 167,
    168, 169, 170, 178, 179, 180, 181, 182, 183, 184, 185, 186, 194, 195, 196, 197,
    198, 199, 200, 201, 202, 210, 211, 212, 213, 214, 215, 216, 217, 218, 225, 226,
    227, 228, 229, 230, 231, 232, 233, 234, 241, 242, 243, 244, 245, 246, 247, 248,
    249, 250,
)
AC_CHROMINANCE_BITS = (
    0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119,
)
AC_CHROMINANCE_SYMBOLS = (
    0, 1, 2, 3, 17, 4, 5, 33, 49, 6, 18, 65, 81, 7, 97, 113,
    19, 34, 50, 129, 8, 20, 66, 145, 161, 177, 193, 9, 35, 51, 82, 240,
    21, 98, 114, 209, 10, 22, 36, 52, 225, 37, 241, 23, 24, 25, 26, 38,
    39, 40, 41, 42, 53, 54, 55, 56, 57, 58, 67, 68, 69, 70, 71, 72,
    73, 74, 83, 84, 85, 86, 87, 88, 89, 90, 99, 100, 101, 102, 103, 104,
    105, 106, 115, 116, 117, 118, 119, 120, 121, 122, 130, 131, 132, 133, 134, 135,
    136, 137, 138, 146, 147, 148, 149, 150, 151, 152, 153, 154, 162, 163, 164, 165,
    166, 167, 168, 169, 170, 178, 179, 180, 181, 182, 183, 184, 185, 186, 194, 195,
    196, 197, 198, 199, 200, 201, 202, 210, 211, 212, 213, 214, 215, 216, 217, 218,
    226, 227, 228, 229, 230, 231, 232, 233, 234, 242, 243, 244, 245, 246, 247, 248,
    249, 250,
)

XYB_GLOBAL_SCALE = 1.43951668
# Base matrix of the XYB space, by component and natural order.
XYB_BASE = (
    7.5629935, 19.824781, 22.572495, 20.67067, 22.686459, 23.569628, 25.812908, 36.330757,
    19.824781, 21.550318, 19.937223, 20.542421, 21.86455, 23.904139, 28.284407, 32.660976,
    22.572495, 19.937223, 21.901726, 19.122345, 21.751581, 24.67247, 25.424965, 32.665382,
    20.67067, 20.542421, 19.122345, 20.161022, 25.371969, 25.96689, 30.980495, 31.340601,
    22.686459, 21.86455, 21.751581, 25.371969, 26.243185, 40.59922, 43.262463, 63.301094,
    23.569628, 23.904139, 24.67247, 25.96689, 40.59922, 48.302677, 34.096436, 61.985214,
    25.812908, 28.284407, 25.424965, 30.980495, 43.262463, 34.096436, 34.493744, 66.970276,
    36.330757, 32.660976, 32.665382, 31.340601, 63.301094, 61.985214, 66.970276, 39.96527,
    1.6262001, 3.2199242, 3.490378, 3.9148359, 4.8337212, 4.9108844, 5.313712, 6.1676793,
    3.2199242, 3.4547899, 3.603683, 4.2652836, 4.8368387, 4.8226223, 5.6120515, 6.3431473,
    3.490378, 3.603683, 3.904456, 4.3374395, 4.8435097, 5.405798, 5.606636, 6.1075134,
    3.9148359, 4.2652836, 4.3374395, 4.6064835, 5.1751475, 5.4013925, 6.039981, 6.782523,
    4.8337212, 4.8368387, 4.8435097, 5.1751475, 5.374805, 6.1410837, 7.6529307, 7.5235214,
    4.9108844, 4.8226223, 5.405798, 5.4013925, 6.1410837, 6.3431473, 7.108305, 7.60083,
    5.313712, 5.6120515, 5.606636, 6.039981, 7.6529307, 7.108305, 7.0943155, 7.0478363,
    6.1676793, 6.3431473, 6.1075134, 6.782523, 7.5235214, 7.60083, 7.0478363, 6.9186144,
    3.3038473, 10.068926, 12.278522, 14.604117, 16.210732, 19.231453, 28.012955, 55.66829,
    10.068926, 11.408502, 11.387135, 15.493417, 16.536493, 14.915342, 26.374872, 40.861443,
    12.278522, 11.387135, 17.088688, 13.950035, 16.000322, 28.566063, 26.21242, 30.126013,
    14.604117, 15.493417, 13.950035, 21.123503, 26.157978, 25.557922, 40.685936, 33.805634,
    16.210732, 16.536493, 16.000322, 26.157978, 26.804283, 26.158772, 35.734398, 43.685703,
    19.231453, 14.915342, 28.566063, 25.557922, 26.158772, 34.541813, 41.319794, 48.786766,
    28.012955, 26.374872, 26.21242, 40.685936, 35.734398, 41.319794, 47.632946, 55.349846,
    55.66829, 40.861443, 30.126013, 33.805634, 43.685703, 48.786766, 55.349846, 63.60656,
)

GLOBAL_SCALE = 1.7396601
DISTANCE_BEND = 1.5
ZERO_BIAS_OFFSET_AC = (0.59082, 0.58146, 0.57988)
FLAT = (16,) * 64
VARIANTS = {
    0: (ANNEX_K_LUMA, ANNEX_K_CHROMA),
    1: (FLAT, FLAT),
    2: (MSSIM_LUMA, MSSIM_CHROMA),
    3: (IMAGE_MAGICK_LUMA, IMAGE_MAGICK_LUMA),
    4: (PSNR_HVS_LUMA, PSNR_HVS_CHROMA),
    5: (KLEIN_LUMA, KLEIN_LUMA),
    6: (WATSON_LUMA, WATSON_LUMA),
    7: (AHUMADA_LUMA, AHUMADA_LUMA),
    8: (PETERSON_LUMA, PETERSON_LUMA),
}


def zigzag() -> list[int]:
    """Natural index of each zigzag position: along the anti-diagonals, turning at each end."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    return [8 * r + c for r, c in cells]


ZIGZAG = zigzag()
#: Cosine basis scaled by 2^13: w(u, x).
BASIS = [[round(8192 * (math.sqrt(0.125) if u == 0 else 0.5) * math.cos((2 * x + 1) * u * math.pi / 16)) for x in range(8)] for u in range(8)]


def quality_scale(quality: int) -> int:
    quality = min(100, max(1, quality))
    return 5000 // quality if quality < 50 else 200 - 2 * quality


def quant_table(base: tuple[int, ...], quality: int) -> list[int]:
    """A base matrix at a quality of 1 to 100, entries 1 to 255."""
    return [min(255, max(1, (b * quality_scale(quality) + 50) // 100)) for b in base]


def code_lengths(bits: tuple[int, ...], symbols: tuple[int, ...]) -> dict[int, int]:
    """Code length of each symbol of a Huffman table in wire form."""
    lengths = [i + 1 for i, n in enumerate(bits) for _ in range(n)]
    return dict(zip(symbols, lengths, strict=True))


STANDARD_CODES = {
    "dc_luma": (DC_LUMINANCE_BITS, DC_LUMINANCE_SYMBOLS),
    "dc_chroma": (DC_CHROMINANCE_BITS, DC_CHROMINANCE_SYMBOLS),
    "ac_luma": (AC_LUMINANCE_BITS, AC_LUMINANCE_SYMBOLS),
    "ac_chroma": (AC_CHROMINANCE_BITS, AC_CHROMINANCE_SYMBOLS),
}


def standard_code_rows() -> list[tuple[str, int, int, int]]:
    """table_id, ord, len and symbol of the four standard tables."""
    rows = []
    for table, (bits, symbols) in STANDARD_CODES.items():
        lengths = code_lengths(bits, symbols)
        rows += [(table, i, lengths[s], s) for i, s in enumerate(symbols)]
    return rows


def variant_rows() -> list[tuple[int, str, int, int]]:
    """variant, comp, k and base value of every base matrix."""
    return [(v, comp, k, b) for v, pair in VARIANTS.items() for comp, base in zip(("luma", "chroma"), pair, strict=True) for k, b in enumerate(base)]


def perceptual_rows() -> list[tuple[int, int, float, float, float, float]]:
    """comp, k, base, exponent, zero-bias multipliers at low and high quality."""
    return [(c, k, PERCEPTUAL_BASE[64 * c + k], FREQUENCY_EXPONENT[k], ZERO_BIAS_LQ[64 * c + k], ZERO_BIAS_HQ[64 * c + k]) for c in range(3) for k in range(64)]


def xyb_rows() -> list[tuple[int, int, float, float, float]]:
    """comp, k, base of the XYB space, Annex K base (one chroma matrix) and exponent."""
    return [(c, k, XYB_BASE[64 * c + k], float((ANNEX_K_CHROMA if c else ANNEX_K_LUMA)[k]), FREQUENCY_EXPONENT[k]) for c in range(3) for k in range(64)]


def values_sql(name: str, columns: str, rows: list[tuple]) -> str:
    """A common table expression of literal rows that both dialects read."""
    lit = lambda x: f"'{x}'" if isinstance(x, str) else f"{x!r}e0" if isinstance(x, float) else str(x)
    return f"{name}({columns}) AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t)"


def frame(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """The same rows as a DataFrame; none of these tables has over 1200 rows."""
    return spark.createDataFrame(rows, columns)


def longs(values: list[int]) -> Column:
    """A literal array<bigint>, parsed in one step."""
    return F.expr("array(" + ", ".join(f"{v}L" for v in values) + ")")
