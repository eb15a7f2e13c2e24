"""Physical constants; fixed values, SI units."""

G = 9.80665
OMEGA = 7.2921e-5
RADIUS = 6371229.0
R_D = 287.05
R_V = 461.51
CP_D = 1005.0
RDV = R_D / R_V
O_RDV = 1 - RDV
RVD_O = R_V / R_D - 1
RDOCP = R_D / CP_D
B1 = 611.21
B2_WATER = 17.502
B2_ICE = 22.587
B3 = 273.16
B4_WATER = 32.19
B4_ICE = -0.7
P_REF = 101325.0
EMISSIVITY = 0.996
STEFAN_BOLTZMANN = 5.6697e-8
KAPPA = 0.285691
EPSILON = 0.621981
T_FREEZE = 273.15
LAPSE = 0.0065
